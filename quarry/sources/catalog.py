"""A catalog of projects, sources and index tables: Parquet directories by version, and numbered pointer files, each of which lists
the versions of all tables. A commit writes its tables and then creates the next pointer, which must not exist; readers take the last
pointer that is complete. So a commit of several tables is seen whole or not at all, also after a crash, and of
two commits that start from the same pointer one fails, or is based anew if the other changed other tables. Paths may be of any file system that Spark knows
and that creates a file only once (as HDFS does)."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


class Conflict(Exception):
    """Another commit changed a table between its read and this commit."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._read: dict[str, str | None] = {}  # the versions that this object read last

    # Versions.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/pointers")
        return sorted((int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()), reverse=True) if fs.exists(p) else []

    def _pointer(self) -> tuple[int, dict[str, str]]:
        """The last complete pointer: its number (0 if there is none) and the version of each table."""
        for n in self._pointers():
            lines = [r[0] for r in self.spark.read.text(f"{self.root}/pointers/{n:012d}").collect()]
            if "end" in lines:
                return n, dict(x.split("\t", 1) for x in lines if "\t" in x)
        return 0, {}

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Writes the tables to new directories, then creates a pointer. Conflict: a table that is written was changed by
        another commit since this object read it."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{version}")
        while True:
            _, now = self._pointer()
            for name in tables:
                if name in self._read and now.get(name) != self._read[name]:
                    raise Conflict(name)
            number = (self._pointers() or [0])[0] + 1
            fs, to = self._fs(f"{self.root}/pointers/{number:012d}")
            try:
                out = fs.create(to, False)
                break
            except Exception:  # another commit was faster: look at what it changed
                if not fs.exists(to):
                    raise
        out.write(bytearray(("".join(f"{k}\t{v}\n" for k, v in sorted((now | dict.fromkeys(tables, version)).items())) + "end\n").encode()))
        out.close()
        self._read.update(dict.fromkeys(tables, version))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes pointers but the last `keep`, and the versions that none of these names. Not beside a commit."""
        numbers = self._pointers()
        live = set()
        for n in numbers[:keep]:
            live |= {tuple(r[0].split("\t", 1)) for r in self.spark.read.text(f"{self.root}/pointers/{n:012d}").collect() if "\t" in r[0]}
        for n in numbers[keep:]:
            fs, p = self._fs(f"{self.root}/pointers/{n:012d}")
            fs.delete(p, False)
        fs, top = self._fs(self.root)
        for t in fs.listStatus(top):
            if t.getPath().getName() != "pointers":
                for v in fs.listStatus(t.getPath()):
                    if (t.getPath().getName(), v.getPath().getName()) not in live:
                        fs.delete(v.getPath(), True)

    def table(self, name: str, ddl: str) -> DataFrame:
        version = self._pointer()[1].get(name)
        self._read[name] = version
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/{version}") if version else self.spark.createDataFrame([], ddl)

    # Projects.

    def projects(self) -> DataFrame:
        """Newest first."""
        return self.table("projects", schema.PROJECTS).orderBy(F.desc("created_at"), "id")

    def create_project(self, name: str, description: str = "", settings: str = "{}") -> str:
        pid = re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", name.strip().lower()))
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = self.spark.createDataFrame([(pid, name, description, settings, now, now)], schema.PROJECTS)
        self.commit({"projects": self.table("projects", schema.PROJECTS).filter(F.col("id") != pid).unionByName(row)})
        return pid

    def update_project(self, pid: str, **values: str) -> None:
        t = self.table("projects", schema.PROJECTS)
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        for k, v in values.items():
            t = t.withColumn(k, F.when(F.col("id") == pid, F.lit(v)).otherwise(F.col(k)))
        self.commit({"projects": t.withColumn("updated_at", F.when(F.col("id") == pid, now).otherwise(F.col("updated_at")))})

    def delete_project(self, pid: str) -> None:
        """With its sources, workspaces, packages, files, nodes, edges and open references."""
        ws = self.table("workspaces", schema.WORKSPACES)
        gone = ws.filter(F.col("project_id") == pid).select(F.col("id").alias("workspace_id"))
        nodes = self.table("nodes", schema.NODES).join(gone, "workspace_id", "left_anti").select(*[c.split()[0] for c in schema.NODES.split(", ")])
        ids = nodes.select(F.col("node_id").alias("end"))
        edges = self.table("edges", schema.EDGES)
        self.commit({
            "projects": self.table("projects", schema.PROJECTS).filter(F.col("id") != pid),
            "sources": self.table("sources", schema.SOURCES).filter(F.col("project_id") != pid),
            "workspaces": ws.filter(F.col("project_id") != pid),
            "packages": self.table("packages", schema.PACKAGES).join(gone, "workspace_id", "left_anti").select(*[c.split()[0] for c in schema.PACKAGES.split(", ")]),
            "nodes": nodes,
            "refs": self.table("refs", schema.REFS).join(ids, F.col("source_id") == F.col("end"), "left_semi"),
            "files": self.table("files", schema.FILES).join(gone, F.col("source_id") == F.col("workspace_id"), "left_anti"),
            "edges": edges.join(ids, F.col("source_id") == F.col("end"), "left_semi").join(ids, F.col("target_id") == F.col("end"), "left_semi"),
        })

    # Sources.

    def add_source(self, pid: str, path: str, source_type: str = "git_repo", is_code: bool = True, alias: str = "") -> str:
        """The path must exist; the alias is its last segment unless given."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        alias = alias or path.rstrip("/").rpartition("/")[2]
        sid = f"{pid}/" + re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", alias.strip().lower()))
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = self.spark.createDataFrame([(sid, pid, path, source_type, is_code, alias, None, None, None, now)], schema.SOURCES)
        self.commit({"sources": self.table("sources", schema.SOURCES).filter(F.col("id") != sid).unionByName(row)})
        return sid

    def sources(self, pid: str) -> DataFrame:
        return self.table("sources", schema.SOURCES).filter(F.col("project_id") == pid).withColumn("alias", F.coalesce("alias", F.lit(""))).orderBy(F.desc("added_at"), "id")

    def remove_source(self, sid: str) -> None:
        self.commit({"sources": self.table("sources", schema.SOURCES).filter(F.col("id") != sid)})

    def mark_indexed(self, sid: str, commit: str = "", branch: str = "") -> None:
        t, own = self.table("sources", schema.SOURCES), F.col("id") == sid
        now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        new = {"last_indexed_commit": F.lit(commit or None).cast("string"), "last_indexed_branch": F.lit(branch or None).cast("string"), "last_indexed_at": now}
        self.commit({"sources": t.select(*[F.when(own, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in t.columns])})

    def project_of(self, directory: str) -> str | None:
        """The project whose source's path is the longest that holds a directory."""
        d = F.lit(directory.rstrip("/"))
        row = self.table("sources", schema.SOURCES).filter((d == F.rtrim("path")) | d.startswith(F.concat(F.col("path"), F.lit("/")))).orderBy(F.desc(F.length("path")), "id").select("project_id").first()
        return row[0] if row else None

    def last_indexed(self, pid: str):
        return self.sources(pid).agg(F.max("last_indexed_at")).first()[0]
