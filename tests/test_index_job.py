"""The index job over a catalog: idempotence, incremental runs, stale rows, imports between sources."""

import os

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import embedding
from quarry.plans import index_job
from quarry.sources.catalog import Catalog, Conflict

from .test_sources import put

LIB = {"package.json": '{"name": "@x/lib"}', "src/index.ts": "export function main() { helper(1); }\nexport function helper(n: number) { return n; }\n", "src/util/dates.ts": "export function today() { return 1; }\n"}
APP = {"package.json": '{"name": "app"}', "a.ts": 'import { main } from "@x/lib";\nimport { today } from "@x/lib/dates";\nimport y from "left-pad";\nimport z from "@x/lib/absent";\nexport function start() { own(); }\nexport function own() {}\n', "b.ts": 'import { own } from "./a";\nexport function second() { own(); }\n'}


class Counting(embedding.Hashed):
    pass


def names(catalog, table, ddl, *cols):
    return {tuple(r) for r in catalog.table(table, ddl).select(*cols).collect()}


def edges(catalog):
    short = lambda c: F.element_at(F.split(c, "::"), -1)
    return {tuple(r) for r in catalog.table("edges", schema.EDGES).select(short("source_id"), short("target_id"), "kind").collect()}


@pytest.fixture
def project(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    pid = c.create_project("P")
    lib, app = put(tmp_path / "lib", LIB), put(tmp_path / "app", APP)
    c.add_source(pid, lib, alias="lib")
    c.add_source(pid, app, alias="app")
    c.add_source(pid, put(tmp_path / "docs", {"x.md": "y"}), is_code=False, alias="docs")
    return c, pid, lib, app


def test_full_run_then_nothing_then_changes(project):
    c, pid, lib, app = project
    provider = Counting(16)
    first = index_job.run(c, pid, provider)
    assert (first.sources, first.skipped, first.errors) == (2, 1, []) and first.nodes == first.embedded == 6
    # Imports between sources: the package's entry file, a subpath by LIKE; no false matches.
    assert {("start", "main", "imports"), ("start", "today", "imports"), ("second", "own", "calls"), ("main", "helper", "calls")} <= edges(c)
    assert first.resolved == 2 and first.still_unresolved == 2
    assert names(c, "refs", schema.REFS, "raw_import") == {("left-pad",), ("@x/lib/absent",)}
    assert all(r.embedding is not None for r in c.table("nodes", schema.NODES).collect())
    everything = (names(c, "nodes", schema.NODES, "node_id"), edges(c))

    again = index_job.run(c, pid, provider)
    assert (again.nodes, again.edges, again.embedded, again.deleted, again.errors) == (0, 0, 0, 0, [])
    assert (names(c, "nodes", schema.NODES, "node_id"), edges(c)) == everything
    forced = index_job.run(c, pid, provider, full=True)  # everything parsed anew, vectors reused
    assert forced.nodes == 6 and forced.embedded == forced.deleted == 0
    assert (names(c, "nodes", schema.NODES, "node_id"), edges(c)) == everything

    # One body changes, one symbol goes, one file goes, one comes.
    put(app, {"a.ts": APP["a.ts"].replace("export function own() {}", "export function own() { return 2; }"), "c.ts": 'import { own } from "./a";\nexport function third() { own(); }\n'})
    os.remove(os.path.join(app, "b.ts"))
    put(lib, {"src/index.ts": "export function main() { return 1; }\n"})
    third = index_job.run(c, pid, provider)
    assert third.errors == [] and third.deleted == 2  # second, helper
    assert third.embedded == 3  # own, third, main
    got = edges(c)
    assert {("third", "own", "calls"), ("start", "main", "imports"), ("start", "own", "calls")} <= got and not any({"second", "helper"} & set(e) for e in got)
    ids = names(c, "nodes", schema.NODES, "node_id")
    assert {e for r in c.table("edges", schema.EDGES).collect() for e in (r.source_id, r.target_id)} <= {i for (i,) in ids}


def test_too_many_changes_block_a_source_but_not_the_others(project):
    c, pid, lib, app = project
    index_job.run(c, pid, Counting(8))
    put(app, {f"n{i}.ts": "export function f() {}" for i in range(4)})
    put(lib, {"src/new.ts": "export function fresh() {}"})
    out = index_job.run(c, pid, Counting(8), most=3)
    assert out.sources == 1 and len(out.errors) == 1 and "app" in out.errors[0] and out.nodes == 1
    assert index_job.run(c, pid, Counting(8), most=0).errors == []


def test_a_removed_source_leaves_no_rows_after_its_project_goes(project):
    c, pid, *_ = project
    index_job.run(c, pid, Counting(8))
    c.delete_project(pid)
    assert c.table("nodes", schema.NODES).count() == c.table("edges", schema.EDGES).count() == c.table("packages", schema.PACKAGES).count() == c.table("refs", schema.REFS).count() == c.table("files", schema.FILES).count() == 0


def test_commits_are_seen_whole_and_conflicts_are_noticed(spark, tmp_path):
    a, b = Catalog(spark, str(tmp_path / "c")), Catalog(spark, str(tmp_path / "c"))
    a.create_project("one")
    one, two = a.table("projects", schema.PROJECTS), b.table("projects", schema.PROJECTS)
    a.commit({"projects": one})
    with pytest.raises(Conflict):
        b.commit({"projects": two})
    b.commit({"sources": b.table("sources", schema.SOURCES)})  # other tables may change meanwhile
    # A pointer that a crash left unfinished is not read.
    number = a._pointers()[0]
    with open(tmp_path / "c" / "pointers" / f"{number + 1:012d}", "w") as f:
        f.write("projects\tnothing\n")
    assert a.projects().count() == 1
    a.create_project("two")
    assert a.projects().count() == 2 and a._pointers()[0] == number + 2
    a.vacuum(1)
    assert a.projects().count() == 2 and len(a._pointers()) == 1 and len(os.listdir(tmp_path / "c" / "projects")) == 1
