import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.plans.index_job import build
from quarry.schema import PACKAGES
from quarry.sources import crawl, detect, parse
from quarry.sources.catalog import Catalog
from quarry.streaming.incremental import upsert_stream

TS = """import { check } from "./util";
/** Runs it. */
export class Job extends Base implements Task {
  run(input: Input): Result { check(input.id); return this.done(); }
}
export const start = async (n: number): Promise<Job> => { return check(n); };
function over(a: string): void;
"""
GO = """package main
import m "math/rand"
// Server serves.
type Server struct {
	Base
	name string
}
func (s *Server) Run(c Config) error { helper(c); return nil }
func helper(c Config) {}
"""


def put(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return str(root)


def test_parsers():
    nodes, edges = parse.parse_file("a.ts", TS)
    assert [(n.kind, n.qualified_name) for n in nodes] == [("class", "Job"), ("method", "Job.run"), ("function", "start")]
    assert nodes[0].docstring == "Runs it." and nodes[0].signature == "class Job extends Base implements Task"
    got = {(e.kind, e.source, e.target) for e in edges}
    assert {("imports", "a.ts", "./util"), ("extends", "Job", "Base"), ("implements", "Job", "Task"), ("calls", "Job.run", "check"), ("uses_type", "Job.run", "Input"), ("contains", "Job", "Job.run"), ("calls", "start", "check")} <= got
    nodes, edges = parse.parse_file("a.go", GO)
    assert [(n.kind, n.qualified_name) for n in nodes] == [("struct", "Server"), ("method", "Server.Run"), ("function", "helper")]
    got = {(e.kind, e.source, e.target) for e in edges}
    assert {("imports", "a.go", "math/rand"), ("embeds", "Server", "Base"), ("calls", "Server.Run", "helper"), ("uses_type", "helper", "Config")} <= got
    assert parse.parse_file("e.ts", "") == ([], [])
    with pytest.raises(ValueError):
        parse.parse_file("a.py", "")


def test_crawl(spark, tmp_path):
    root = put(tmp_path / "src", {"a.ts": "x", "b.md": "y", "node_modules/c.ts": "z", ".hid/d.ts": "w", "big.ts": "x" * 200_000, "gen/e.ts": "v", "sub/f.go": "u", "sub/g.go": "t", "yarn.lock": "", ".gitignore": "gen/\n# note\n!keep", "sub/.gitignore": "g.go\n", "debug.log": ""})
    os.symlink(os.path.join(root, "a.ts"), os.path.join(root, "link.ts"))
    assert sorted(r.file_path for r in crawl.crawl(spark, root).collect()) == ["a.ts", "sub/f.go"]
    assert "b.md" in {r.file_path for r in crawl.crawl(spark, root, is_code=False).collect()}
    assert {r.ext: r.n for r in crawl.crawl_stats(crawl.crawl(spark, root)).collect()} == {".ts": 1, ".go": 1}


def test_detection(tmp_path):
    root = put(tmp_path / "m", {"package.json": '{"name": "root", "workspaces": {"packages": ["packages/*", "!packages/skip"]}}', "yarn.lock": "", "packages/core/package.json": '{"name": "@x/core", "version": "1.0"}', "packages/skip/package.json": "{}", "tsconfig.base.json": '{"compilerOptions": {"paths": {"@lib/*": ["lib/*"]}}}', "tsconfig.json": '{\n// c\n"extends": "./tsconfig.base", "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"],}}}'})
    w = detect.detect_workspace(root)
    assert (w.workspace_type, w.package_manager, [(p.name, p.path, p.version) for p in w.packages]) == ("monorepo", "yarn", [("@x/core", "packages/core", "1.0")])
    assert w.tsconfig_paths == {"@lib": "lib", "@app": "src"}
    g = detect.detect_workspace(put(tmp_path / "g", {"go.work": "go 1.22\nuse (\n\t./a\n\t./b // c\n)\n", "a/go.mod": "module ex.com/a\n", "b/go.mod": "module ex.com/b\n"}))
    assert (g.workspace_type, g.aliases) == ("monorepo", {"ex.com/a": "a", "ex.com/b": "b"})
    assert detect.detect_workspace(put(tmp_path / "n", {"x.txt": ""})).workspace_type == "standalone"


def test_git_changes(spark, tmp_path):
    root = put(tmp_path / "r", {"a.ts": "1\n" * 30, "b.ts": "2", "c.md": "3"})
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    assert crawl.git_changes(root).full
    run("add", ".")
    run("commit", "-qm", "one")
    first = crawl.git_changes(root)
    assert first.full and crawl.git_changes(root, first.commit).added == []
    put(root, {"b.ts": "22", "d.ts": "4", "e.md": ""})
    os.rename(f"{root}/a.ts", f"{root}/z.ts")
    run("add", "-A")
    run("commit", "-qm", "two")
    c = crawl.git_changes(root, first.commit)
    assert (sorted(c.added), c.modified, c.deleted, c.full, c.blocked) == (["d.ts", "z.ts"], ["b.ts"], ["a.ts"], False, False)
    assert crawl.git_changes(root, first.commit, most=2).blocked and crawl.git_changes(root, "f" * 40).full
    assert [r.file_path for r in crawl.only_changed(crawl.crawl(spark, root), c).orderBy("file_path").collect()] == ["b.ts", "d.ts", "z.ts"]


def test_index_job(spark, tmp_path):
    root = put(tmp_path / "p", {"package.json": '{"name": "app"}', "src/a.ts": TS, "src/util.ts": "export function check(x: any) { return x; }\nexport class Base { done() {} }\n", "src/bad.go": "package x\nfunc broken(", "src/ext.ts": 'import x from "left-pad";\nexport function f() { x(); }'})
    out = build(spark, root, "ws")
    names = {r.qualified_name: r.node_id for r in out["nodes"].collect()}
    assert names["Job.run"] == "ws/app/src/a.ts::Job.run"
    got = {(r.source_id.split("::")[1], r.target_id.split("::")[1], r.kind) for r in out["edges"].collect()}
    assert {("Job.run", "check", "calls"), ("Job", "Base", "extends"), ("Job", "Job.run", "contains"), ("Job", "check", "imports")} <= got
    assert [r.raw_import for r in out["refs"].collect()] == ["left-pad"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.create_project("  My Project! ") == "my-project"
    sid = c.add_source("my-project", str(tmp_path), alias="Main Repo")
    assert sid == "my-project/main-repo" and [r.alias for r in c.sources("my-project").collect()] == ["Main Repo"]
    assert c.project_of(str(tmp_path) + "/deep/er") == "my-project" and c.project_of(str(tmp_path) + "x") is None
    c.mark_indexed(sid, "abc")
    row = c.sources("my-project").first()
    assert row.last_indexed_commit == "abc" and row.last_indexed_branch is None and c.last_indexed("my-project") is not None
    c.update_project("my-project", description="d")
    assert c.projects().first().description == "d"
    with pytest.raises(FileNotFoundError):
        c.add_source("my-project", str(tmp_path / "none"))
    c.delete_project("my-project")
    assert c.projects().count() == 0 and c.sources("my-project").count() == 0


def test_stream_upserts(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    ddl = PACKAGES + ", seq int, deleted boolean"
    rows = lambda *r: spark.createDataFrame([(i, "w", n, ".", "1", s, d) for i, n, s, d in r], ddl)
    src = str(tmp_path / "in")
    for batch in (rows(("a", "x", 1, False), ("a", "y", 2, False), ("b", "z", 1, False)), rows(("b", "z", 3, True), ("c", "q", 4, False))):
        batch.write.mode("append").parquet(src)
        q = upsert_stream(spark.readStream.schema(ddl).parquet(src), c, "packages", PACKAGES, ["package_id"] if "package_id" in PACKAGES else ["id"], "seq", str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {tuple(r)[:3] for r in c.table("packages", PACKAGES).select(F.col("id"), F.col("workspace_id"), F.col("name")).collect()} == {("a", "w", "y"), ("c", "w", "q")}


def test_crawl_totals_and_directory_scan(spark, tmp_path):
    root = put(tmp_path / "src", {"a.ts": "x", "b.md": "y", "node_modules/c.ts": "z", "sub/f.go": "u"})
    assert tuple(crawl.crawl_totals(spark, root).first()) == (4, 2, 2)
    put(tmp_path / "all", {"mono/.git/HEAD": "", "mono/package.json": '{"workspaces": ["p/*"]}', "pnpm/.git/HEAD": "", "pnpm/package.json": "{}", "pnpm/pnpm-workspace.yaml": "", "repo/.git/HEAD": "", "plain/x.txt": "", ".hidden/x": "", "file.txt": ""})
    assert crawl.scan_directory(str(tmp_path / "all")) == [("mono", "monorepo"), ("plain", "directory"), ("pnpm", "monorepo"), ("repo", "git_repo")]


def test_changed_since(spark, tmp_path):
    from datetime import datetime

    root = put(tmp_path / "src", {"old.ts": "x", "new.ts": "y", "new.md": "z"})
    os.utime(f"{root}/old.ts", (1_000_000, 1_000_000))
    assert [r.file_path for r in crawl.changed_since(spark, root, datetime(2001, 1, 1)).collect()] == ["new.ts"]


def test_result_sinks(spark, tmp_path):
    import json

    from quarry.sources import sinks

    df = spark.createDataFrame([(1, "a b", None), (22, None, 0.5)], "id int, name string, score double")
    assert json.loads(sinks.json_document(df.orderBy("id"))) == [{"id": 1, "name": "a b"}, {"id": 22, "score": 0.5}]
    assert sinks.table_text(df.orderBy("id")) == "ID  NAME  SCORE\n1   a b\n22        0.5\n"
    assert list(sinks.events(["one", "two\nlines"])) == ["data: one\n\n", "data: two\ndata: lines\n\n", "data: [DONE]\n\n"]
    sinks.write_json(df, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
