"""The index of a source tree: crawl, parse, resolve, store - one plan of DataFrames - and the job that keeps a catalog's index up to date."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..durable import materialize
from ..functions.embedding import Provider, embed_nodes
from ..functions.text import join_parts, node_id
from ..operators import resolve, store
from ..sources import crawl as fs
from ..sources import parse
from ..sources.catalog import Catalog
from ..sources.detect import Workspace, detect_workspace


def build(spark: SparkSession, root: str, workspace_id: str, workspace: Workspace | None = None, files: DataFrame | None = None, listed: DataFrame | None = None, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges, refs (unresolved imports), package_deps, packages and errors of a source tree. For some of its files only: listed holds
    the paths of all (file_path), and known the stored nodes of the other files, to which imports and calls may lead."""
    ws = workspace or detect_workspace(root.removeprefix("file://"))
    files = files if files is not None else fs.crawl(spark, root, content=True)
    parsed = materialize(parse.parse_files(files))
    packages = spark.createDataFrame([(f"{workspace_id}/{p.name}", workspace_id, p.name, p.path, p.version) for p in ws.packages], "package_id string, workspace_id string, name string, path string, version string")
    raw = parse.nodes_of(parsed)
    owned = resolve.longest_prefix(raw, packages.select(F.col("path").alias("prefix"), "package_id"), "file_path", "prefix")
    ext = F.regexp_extract("file_path", r"(\.[^./]+)$", 1)
    nodes = owned.select(
        node_id(F.col("package_id"), F.lit(workspace_id), F.col("file_path"), F.col("qualified_name")).alias("node_id"), F.lit(workspace_id).alias("workspace_id"), "package_id", "file_path", "name", "qualified_name", "kind",
        fs.language_of(ext).alias("language"), "signature", "start_line", "end_line", "source_code", "docstring", "body_hash", join_parts(F.col("signature"), F.col("docstring"), F.col("source_code")).alias("embedding_input"),
    ).dropDuplicates(["node_id"])
    edges = parse.edges_of(parsed).withColumn("id", F.xxhash64("file_path", "source", "target", "kind", "line"))
    at = nodes.select("file_path", F.col("qualified_name").alias("source"), F.col("node_id").alias("source_id"))
    seen = ["node_id", "file_path", "name", "kind", "start_line"]
    every_node = nodes.select(*seen) if known is None else nodes.select(*seen).unionByName(known.select(*seen))
    first = resolve.first_nodes(every_node.select("node_id", "file_path", "start_line")).select("file_path", F.col("node_id").alias("first_id"))

    imports = edges.filter("kind = 'imports'").select("id", "file_path", F.col("target").alias("specifier"), "line", "symbols")
    aliases = spark.createDataFrame([(a, t) for a, t in ({**ws.tsconfig_paths, **ws.aliases}).items()], "alias string, target string")
    modules = spark.createDataFrame([(p.name, p.path) for p in ws.packages], "module string, dir string")
    listed = files.select("file_path") if listed is None else listed
    done, open_ = resolve.resolve_imports(imports, aliases, listed, modules if ws.package_manager == "go" else None)
    import_edges = done.join(first, "file_path").join(first.select(F.col("file_path").alias("resolved_path"), F.col("first_id").alias("target_id")), "resolved_path").select(F.col("first_id").alias("source_id"), "target_id", F.lit("imports").alias("kind"), F.col("line").alias("line_number"))

    calls = edges.filter("kind = 'calls'").select("id", "file_path", F.col("target").alias("callee"), "source", "line")
    targets = resolve.resolve_calls(calls, every_node.select("node_id", "file_path", "name"), done)
    call_edges = calls.join(targets, "id").join(at, ["file_path", "source"]).select("source_id", "target_id", F.lit("calls").alias("kind"), F.col("line").alias("line_number"))

    # Heritage, type use, embedding and containment: by name, first in the same file.
    named = edges.filter("kind in ('extends', 'implements', 'uses_type', 'embeds')").select("id", "file_path", F.col("target").alias("callee"), "source", "line", "kind")
    typed = resolve.resolve_calls(named.withColumn("callee", F.substring_index("callee", ".", -1)), every_node.filter("kind not in ('method', 'function')").select("node_id", "file_path", "name"), done)
    type_edges = named.join(typed, "id").join(at, ["file_path", "source"]).select("source_id", "target_id", "kind", F.col("line").alias("line_number"))
    inside = edges.filter("kind = 'contains' and source <> file_path").join(at, ["file_path", "source"]).join(at.select("file_path", F.col("source").alias("target"), F.col("source_id").alias("target_id")), ["file_path", "target"]).select("source_id", "target_id", "kind", F.col("line").alias("line_number"))

    every = import_edges.unionByName(call_edges).unionByName(type_edges).unionByName(inside).filter("source_id <> target_id").withColumn("weight", store.edge_weight(F.col("kind")))
    return {
        "packages": packages,
        "nodes": nodes,
        "edges": store.dedup_max(every, "line_number"),
        "refs": open_.join(first, "file_path").select(F.col("first_id").alias("source_id"), F.lit(workspace_id).alias("workspace_id"), F.col("specifier").alias("raw_import"), F.lit("imports").alias("kind"), F.col("line").alias("line_number")),
        "package_deps": resolve.package_pairs_of_files(done),
        "errors": parsed.filter("error is not null").select("file_path", "error"),
    }


MOST_CHANGES = 100


@dataclass
class Counters:
    """What a run did."""

    sources: int = 0
    skipped: int = 0
    nodes: int = 0
    edges: int = 0
    embedded: int = 0
    deleted: int = 0
    resolved: int = 0
    still_unresolved: int = 0
    errors: list[str] = field(default_factory=list)


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def run(catalog: Catalog, project_id: str, provider: Provider, *, full: bool = False, most: int = MOST_CHANGES) -> Counters:
    """Indexes the changed files of each source of a project; then imports between its sources. A source that fails, or has more than `most`
    changed files (0: no bound) when it is not indexed for the first time or in full, is an error in the counters, and the others go on."""
    out = Counters()
    sources = catalog.sources(project_id).orderBy("alias", "id").collect()  # a project's sources: a few
    for source in sources:
        if not source.is_code:
            out.skipped += 1
            continue
        try:
            index_source(catalog, source, provider, out, full, most)
            out.sources += 1
        except Exception as x:  # noqa: BLE001 - one source's failure does not end the job
            out.errors.append(f"source {source.alias}: {x}")
    if sum(s.is_code for s in sources) > 1 and out.sources:
        resolve_across(catalog, project_id, out)
    return out


def index_source(catalog: Catalog, source, provider: Provider, out: Counters, full: bool = False, most: int = MOST_CHANGES) -> None:
    """One source: compare the files' digests with those of the last run, parse what changed, reuse vectors of equal bodies, and commit all
    tables at once. A second run over the same files commits nothing."""
    spark, ws_id = catalog.spark, source.id
    files = materialize(fs.crawl(spark, source.path, content=True).withColumn("digest", F.sha2("content", 256)))
    stored = catalog.table("files", schema.FILES)
    old = stored.filter(F.col("source_id") == ws_id)
    first = full or not old.head(1)
    changes = materialize(store.diff_snapshots(old, files, "file_path"))
    if store.over_threshold(changes, most, first):
        raise ValueError(f"more than {most} files changed")
    if not first and not changes.head(1):
        return
    workspace = detect_workspace(source.path.removeprefix("file://"))
    some = files if first else files.join(changes.filter("change <> 'deleted'").select("file_path"), "file_path", "left_semi")
    gone = changes.filter("change = 'deleted'").select("file_path")
    touched = materialize(some.select("file_path").unionByName(gone))

    nodes = catalog.table("nodes", schema.NODES)
    own, others = nodes.filter(F.col("workspace_id") == ws_id), nodes.filter(F.col("workspace_id") != ws_id)
    kept = own.join(touched, "file_path", "left_anti").select(*nodes.columns)
    g = build(spark, source.path, ws_id, workspace, some, files.select("file_path"), kept)
    made = store.reuse(g["nodes"], own, ["node_id"])
    out.embedded += (made := materialize(made)).filter("embedding is null").count()
    made = materialize(embed_nodes(made, provider).select(*nodes.columns))
    new_nodes = materialize(kept.unionByName(made))
    before = own.join(touched, "file_path", "left_semi").select("node_id")
    out.deleted += own.select("node_id").join(new_nodes.select("node_id"), "node_id", "left_anti").count()
    every = others.unionByName(new_nodes)

    edges = catalog.table("edges", schema.EDGES)
    incoming = materialize(g["edges"].select("source_id", "target_id", "kind", "weight", F.col("line_number").cast("int").alias("line_number")))
    rest = store.replace_edges(edges, before.unionByName(made.select("node_id")), incoming)
    refs = catalog.table("refs", schema.REFS)
    away = before.unionByName(made.select("node_id")).select(F.col("node_id").alias("source_id")).distinct()
    open_ = refs.join(away, "source_id", "left_anti").select(*refs.columns).unionByName(g["refs"].select("source_id", "raw_import", "kind", F.col("line_number").cast("int").alias("line_number")))
    live = every.select(F.col("node_id").alias("source_id"))
    packages = catalog.table("packages", schema.PACKAGES)
    workspaces = catalog.table("workspaces", schema.WORKSPACES)
    row = spark.createDataFrame([(ws_id, source.project_id, ws_id, source.alias, source.path, workspace.workspace_type, workspace.package_manager)], schema.WORKSPACES)
    here = g["packages"].select(F.col("package_id").alias("id"), "workspace_id", "name", "path", "version")
    catalog.commit({
        "nodes": every,
        "edges": store.cascade(rest, every).select(*edges.columns),
        "refs": open_.join(live, "source_id", "left_semi").select(*refs.columns),
        "packages": packages.filter(F.col("workspace_id") != ws_id).unionByName(here),
        "workspaces": store.upsert(workspaces, row, ["id"]),
        "files": stored.filter(F.col("source_id") != ws_id).unionByName(files.select(F.lit(ws_id).alias("source_id"), "file_path", "digest")),
    })
    out.nodes += made.count()
    out.edges += incoming.count()
    catalog.mark_indexed(ws_id)


def resolve_across(catalog: Catalog, project_id: str, out: Counters) -> None:
    """Ties open imports of a project to packages of its other sources: the edges are added, the references end."""
    ws = catalog.table("workspaces", schema.WORKSPACES).filter(F.col("project_id") == project_id).select(F.col("id").alias("workspace_id"))
    every = catalog.table("nodes", schema.NODES)
    nodes = every.join(ws, "workspace_id", "left_semi")
    packages = catalog.table("packages", schema.PACKAGES).join(ws, "workspace_id", "left_semi").select(F.col("id").alias("package_id"), "workspace_id", "name", "path")
    refs = catalog.table("refs", schema.REFS)
    own = refs.join(nodes.select(F.col("node_id").alias("source_id"), "workspace_id"), "source_id")
    links = materialize(resolve.cross_links(own, packages, nodes))
    counts = resolve.cross_counts(own, links).first()
    out.resolved, out.still_unresolved = counts.resolved, counts.still_unresolved
    if not out.resolved:
        return
    edges = catalog.table("edges", schema.EDGES)
    line = own.filter("kind = 'imports'").groupBy("source_id", "raw_import").agg(F.min("line_number").alias("line_number"))
    new = links.join(line, ["source_id", "raw_import"]).select("source_id", "target_id", F.lit("imports").alias("kind"), F.lit(0.5).alias("weight"), "line_number")
    catalog.commit({"edges": store.dedup_max(edges.unionByName(new), "line_number").select(*edges.columns), "refs": resolve.open_refs(refs, links)})
