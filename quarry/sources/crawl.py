"""Directory crawl: Spark lists the files, predicates on path and length choose them; .gitignore rules are compiled to
expressions. Change detection compares two such listings, or asks git."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MAX_KB = 100
CODE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".go"]
SKIP_DIRS = ["node_modules", ".git", "dist", "build", ".next", "__pycache__", "vendor", "testdata", "bower_components"]
SKIP_FILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.sum"]


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over root-relative paths, negated) of a .gitignore line; None for blanks and comments."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p.removeprefix("!").removeprefix("\\")
    directory, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if directory else "(?:/|$)"), negated


def ignored(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Whether a root-relative path is ignored by (directory, lines) rules; within a file the last rule that matches decides,
    and any file's verdict suffices. Nested files' patterns are matched against the root-relative path too."""
    out = F.lit(False)
    for directory, lines in rules:
        verdict = F.lit(False)
        for line in lines:
            if (r := ignore_regex(line)) is not None:
                verdict = F.when(path.rlike(r[0]), not r[1]).otherwise(verdict)
        out = out | (verdict & (path.startswith(directory + "/") if directory else F.lit(True)))
    return out


def code_file(path: Column) -> Column:
    """A code file by its extension, name and parent directories."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    parents = F.slice(parts, 1, F.size(parts) - 1)
    return F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(CODE_EXTENSIONS) & ~name.isin(SKIP_FILES) & ~F.exists(parents, lambda d: d.isin(SKIP_DIRS) | d.startswith("."))


def _links(root: str) -> list[str]:
    """Root-relative paths of symbolic links, where the root is a local directory."""
    local = root.removeprefix("file://")
    if "://" in local or not os.path.isdir(local):
        return []
    return [os.path.relpath(os.path.join(d, n), local) for d, dirs, files in os.walk(local) for n in [*dirs, *files] if os.path.islink(os.path.join(d, n))]


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, list[str]]]:
    """(directory, lines) of the .gitignore files under root. Spark's own sources do not list hidden files."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toUri().getPath().rstrip("/")
    found, listing = [], fs.listFiles(base, True)
    while listing.hasNext():
        p = listing.next().getPath()
        if p.getName() == ".gitignore":
            stream = fs.open(p)
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((p.toUri().getPath()[len(top) + 1 :].rpartition("/")[0], text.splitlines()))
    return sorted(found)


def crawl(spark: SparkSession, root: str, is_code: bool = True, max_kb: int = MAX_KB, content: bool = False) -> DataFrame:
    """(file_path, ext, size[, content]) of the files under root that are indexed. Contents are read only if asked for.
    Spark's file sources leave out names that begin with an underscore; so does this."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace("path", "^.*?" + re.escape(base) + "/+", "")
    files = listing.select(path.alias("file_path"), F.col("length").alias("size"), *(["content"] if content else []))
    name = F.element_at(F.split("file_path", "/"), -1)
    rules = ignore_files(spark, root)
    parents = F.slice(F.split("file_path", "/"), 1, F.size(F.split("file_path", "/")) - 1)
    keep = ~F.exists(parents, lambda d: d.isin(SKIP_DIRS) | d.startswith("."))
    keep &= ~name.isin(SKIP_FILES) & ~name.rlike(r"\.(?:lock|log)$") & (F.col("size") <= max_kb * 1024) & ~ignored(F.col("file_path"), rules)
    for link in _links(root):
        keep &= (F.col("file_path") != link) & ~F.col("file_path").startswith(link + "/")
    ext = F.regexp_extract("file_path", r"(\.[^./]+)$", 1)
    out = files.filter(keep).withColumn("ext", ext)
    return (out.filter(F.col("ext").isin(CODE_EXTENSIONS)) if is_code else out).select("file_path", "ext", "size", *(["content"] if content else []))


def crawl_totals(spark: SparkSession, root: str, is_code: bool = True) -> DataFrame:
    """One row (total, indexed, skipped): the files under root that Spark lists, and how many of them crawl() keeps."""
    total = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.count(F.lit(1)).alias("total"))
    return total.join(F.broadcast(crawl(spark, root, is_code).select(F.count(F.lit(1)).alias("indexed"))), how="cross").withColumn("skipped", F.col("total") - F.col("indexed"))  # one row each


def crawl_stats(files: DataFrame) -> DataFrame:
    """(ext, n, size)."""
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def language_of(ext: Column) -> Column:
    return F.when(ext.isin(".ts", ".tsx"), "typescript").when(ext.isin(".js", ".jsx"), "javascript").when(ext == ".go", "go")


def scan_directory(root: str) -> list[tuple[str, str]]:
    """(name, kind) of the child directories: monorepo, git_repo or directory."""
    import json

    out = []
    for name in sorted(os.listdir(root)):
        d = os.path.join(root, name)
        if not os.path.isdir(d) or name.startswith("."):
            continue
        kind = "git_repo" if os.path.exists(os.path.join(d, ".git")) else "directory"
        if kind == "git_repo":
            try:
                with open(os.path.join(d, "package.json")) as f:
                    kind = "monorepo" if json.load(f).get("workspaces") else kind
            except (OSError, ValueError, AttributeError):
                pass
            kind = "monorepo" if os.path.exists(os.path.join(d, "pnpm-workspace.yaml")) and os.path.exists(os.path.join(d, "package.json")) else kind
        out.append((name, kind))
    return out


@dataclass
class Changes:
    added: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    full: bool = False
    blocked: bool = False
    commit: str = ""
    branch: str = ""


def _git(root: str, *args: str) -> str | None:
    r = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return r.stdout if r.returncode == 0 else None


def is_code_path(path: str) -> bool:
    *parents, name = path.split("/")
    return os.path.splitext(name)[1] in CODE_EXTENSIONS and name not in SKIP_FILES and not any(p in SKIP_DIRS or p.startswith(".") for p in parents)


def git_changes(root: str, last_commit: str = "", most: int = 100, force: bool = False) -> Changes:
    """What changed since last_commit: copies count as added, renames as deleted and added. Without a usable commit it is a full run;
    more than `most` changed files (0: no bound) block a run that is not full."""
    head = _git(root, "rev-parse", "HEAD")
    out = Changes(commit=(head or "").strip(), branch=(_git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip())
    out.branch = "" if out.branch == "HEAD" else out.branch
    if head is None or force or not last_commit:
        out.full = True
        return out
    if out.commit == last_commit:
        return out
    diff = _git(root, "diff", "--name-status", "-z", last_commit, "HEAD")
    if diff is None:
        out.full = True
        return out
    parts = iter(diff.split("\0"))
    for status in parts:
        if not status:
            continue
        paths = [next(parts)] + ([next(parts)] if status[0] in "RC" else [])
        todo = {"A": [(out.added, 0)], "M": [(out.modified, 0)], "T": [(out.modified, 0)], "D": [(out.deleted, 0)], "R": [(out.deleted, 0), (out.added, 1)], "C": [(out.added, 1)]}.get(status[0], [])
        for where, k in todo:
            if is_code_path(paths[k]):
                where.append(paths[k])
    out.blocked = bool(most) and len(out.added) + len(out.modified) + len(out.deleted) > most
    return out


def changed_since(spark: SparkSession, root: str, moment) -> DataFrame:
    """(file_path) of code files modified after a moment. Deletions do not show; compare snapshots for those."""
    base = root.rstrip("/").removeprefix("file://")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^.*?" + re.escape(base) + "/+", "").alias("file_path"), "modificationTime").filter(code_file(F.col("file_path")) & (F.col("modificationTime") > F.lit(moment))).select("file_path")


def only_changed(files: DataFrame, changes: Changes) -> DataFrame:
    """The crawled files that were added or modified; all in a full run."""
    if changes.full:
        return files
    some = files.sparkSession.createDataFrame([(p,) for p in [*changes.added, *changes.modified]], "file_path string")
    return files.join(some.distinct(), "file_path", "left_semi")
