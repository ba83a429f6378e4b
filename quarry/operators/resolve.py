"""Import and call resolution as joins: candidates are exploded with their priority, joined by equality, and the least one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_symbol, last_segment, normal_path, package_dir, specifier_package, specifier_subpath

# Names that are never resolved to symbols of a project.
NODE_BUILTINS = [
    "assert", "buffer", "child_process", "cluster", "crypto", "dgram", "dns", "domain", "events", "fs", "http", "https", "net", "os", "path",
    "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "tty", "url", "util",
    "v8", "vm", "worker_threads", "zlib", "console", "module",
]
GLOBAL_CALLS = [
    "console.log", "console.error", "console.warn", "console.info", "JSON.stringify", "JSON.parse", "Promise.resolve", "Promise.reject", "Promise.all",
    "Math.round", "Math.floor", "Math.ceil", "Math.random", "parseInt", "parseFloat", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "require", "super", "make", "len", "cap", "append", "copy", "delete", "close", "panic", "recover", "new", "print", "println", "fmt.Sprintf",
    "fmt.Printf", "fmt.Println", "fmt.Fprintf", "fmt.Errorf",
]
GLOBAL_OWNERS = [
    "console", "Math", "Object", "Array", "String", "Number", "Promise",
]
BUILTIN_METHODS = [
    "split", "replace", "replaceAll", "match", "trim", "trimStart", "trimEnd", "toLowerCase", "toUpperCase", "startsWith", "endsWith", "includes",
    "indexOf", "lastIndexOf", "slice", "substring", "charAt", "charCodeAt", "padStart", "padEnd", "repeat", "normalize", "search", "at", "push", "pop",
    "shift", "unshift", "map", "filter", "reduce", "reduceRight", "find", "findIndex", "some", "every", "forEach", "flat", "flatMap", "sort", "reverse",
    "concat", "join", "fill", "splice", "keys", "values", "entries", "hasOwnProperty", "toString", "valueOf", "toJSON", "toLocaleString", "then", "catch",
    "finally", "get", "set", "has", "clear", "add", "getTime", "toISOString", "toDateString", "addEventListener", "removeEventListener", "querySelector",
    "querySelectorAll", "getAttribute", "setAttribute", "createElement", "appendChild", "removeChild", "Error", "String", "Close", "Read", "Write",
    "Scan", "Next", "Err", "Rows",
]
TS_BUILTIN_TYPES = [
    "string", "number", "boolean", "void", "null", "undefined", "any", "never", "unknown", "object", "symbol", "bigint",
]
GO_BUILTIN_TYPES = [
    "string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "float32", "float64", "complex64",
    "complex128", "bool", "byte", "rune", "error", "any",
]
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
ENTRY_FILES = ["src/index.ts", "src/index.tsx", "src/index.js", "src/index.jsx", "index.ts", "index.tsx", "index.js", "index.jsx", "main.go"]


def is_node_builtin(s: Column) -> Column:
    return F.split_part(F.regexp_replace(s, "^node:", ""), F.lit("/"), F.lit(1)).isin(NODE_BUILTINS)


def is_go_stdlib(s: Column) -> Column:
    return ~F.split_part(s, F.lit("/"), F.lit(1)).contains(".")


def is_global_call(s: Column) -> Column:
    return s.isin(GLOBAL_CALLS) | F.substring_index(s, ".", 1).isin(GLOBAL_OWNERS) & s.contains(".")


def is_builtin_method_call(s: Column) -> Column:
    return s.contains(".") & last_segment(s).isin(BUILTIN_METHODS)


def file_candidates(path: Column) -> Column:
    """The files that a path without its extension may mean, in order."""
    forms = [path, *[F.concat(path, F.lit(e)) for e in EXTENSIONS], *[F.concat(path, F.lit("/index" + e)) for e in EXTENSIONS]]
    swapped = [F.when(path.endswith(".js"), F.regexp_replace(path, r"\.js$", e)) for e in (".ts", ".tsx")]
    return F.filter(F.array(*forms, *swapped), lambda x: x.isNotNull())


def probe_files(paths: DataFrame, files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, file_path): the first candidate of each path that exists. paths: (key, path); files: (file_path)."""
    tried = paths.select(key, F.posexplode(file_candidates(F.col(path))).alias("_pos", "file_path"))
    hit = tried.join(files.select("file_path").distinct(), "file_path")
    return hit.groupBy(key).agg(F.min_by("file_path", "_pos").alias("file_path"))


def prefixes(path: Column) -> Column:
    """All prefixes of a path at segment borders, itself first; the empty one is '.'."""
    parts = F.split(path, "/")
    return F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit(".")))


def longest_prefix(paths: DataFrame, owners: DataFrame, path: str, prefix: str) -> DataFrame:
    """paths with the owner whose prefix is the longest that ends at a segment border; the least owner row of equals. A join by equality on the
    few prefixes of a path, not a comparison with all owners."""
    rest = [c for c in owners.columns if c != prefix]
    own = owners.select(F.col(prefix).alias("_prefix"), F.struct(*[F.col(c).alias(c) for c in rest]).alias("_o")).groupBy("_prefix").agg(F.min("_o").alias("_o"))
    tried = paths.select(path).distinct().select(path, F.explode(prefixes(F.col(path))).alias("_prefix"))
    best = tried.join(own, "_prefix").groupBy(path).agg(F.max_by(F.struct("_prefix", "_o"), F.when(F.col("_prefix") == ".", 0).otherwise(F.length("_prefix"))).alias("_b"))
    return paths.join(best, path, "left").select(*paths.columns, F.col("_b._prefix").alias(prefix), *[F.col(f"_b._o.{c}").alias(c) for c in rest])


def resolve_imports(imports: DataFrame, aliases: DataFrame, files: DataFrame, go_modules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved with resolved_path, unresolved) of imports (id, file_path, specifier). aliases: (alias, target) of workspaces and tsconfig paths, the longest wins;
    relative specifiers are joined to the importing file's directory. Builtins of the platform are dropped."""
    src = imports.filter(~F.when(F.col("file_path").endswith(".go"), is_go_stdlib(F.col("specifier"))).otherwise(is_node_builtin(F.col("specifier"))))
    relative = F.col("specifier").startswith(".")
    joined = normal_path(F.concat(F.regexp_replace("file_path", "/?[^/]*$", ""), F.lit("/"), F.col("specifier")))
    rel = src.filter(relative).select("id", joined.alias("path"), F.lit(2).alias("rank"))
    bare = longest_prefix(src.filter(~relative).select("id", "specifier"), aliases, "specifier", "alias").filter("target is not null")
    named = bare.select("id", F.concat("target", F.expr("substring(specifier, length(alias) + 1)")).alias("path"), F.lit(1).alias("rank"))
    found = probe_files(rel.unionByName(named), files, "id")
    if go_modules is not None:
        dirs = files.filter(F.col("file_path").endswith(".go")).select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("path"), "file_path").groupBy("path").agg(F.min("file_path").alias("go_file"))
        own = longest_prefix(src.filter(F.col("file_path").endswith(".go")).select("id", "specifier"), go_modules, "specifier", "module").filter("dir is not null")
        go = own.select("id", F.regexp_replace(F.concat("dir", F.expr("substring(specifier, length(module) + 1)")), r"^\.?/|/$", "").alias("path")).join(dirs, "path").select("id", F.col("go_file").alias("file_path"))
        found = found.unionByName(go).groupBy("id").agg(F.min("file_path").alias("file_path"))
    done = src.join(found.withColumnRenamed("file_path", "resolved_path"), "id", "left")
    return done.filter("resolved_path is not null"), done.filter("resolved_path is null").drop("resolved_path")


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(id, target_id, tier) of calls (id, file_path, callee): a symbol of the same file, else of a file it imports, else the only one of that
    name. nodes: (node_id, file_path, name); imports: (file_path, resolved_path) and, if known, symbols: an import that lists what it
    imports is a source of these names alone, and of what is reached through them (`* as x`: of x.y). Calls of globals are dropped, and
    methods that builtin types have are not looked up everywhere."""
    own = calls.filter(~is_global_call(F.col("callee"))).select("id", "file_path", "callee")
    # A file's calls of one callee have one answer, and a file's symbols of one name count by their least id: neither repeats in a join.
    asked = own.select("file_path", "callee").distinct().withColumn("name", last_segment(F.col("callee")))
    heads = nodes.groupBy("file_path", "name").agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n"))
    found = lambda df, tier: df.select("file_path", "callee", F.struct(F.lit(tier).alias("tier"), "node_id").alias("m"))
    here = found(asked.join(heads, ["file_path", "name"]), 1)
    listed = F.coalesce("symbols", F.array()) if "symbols" in imports.columns else F.array().cast("array<string>")
    linked = imports.select("file_path", "resolved_path", F.transform(listed, clean_symbol).alias("_symbols")).distinct()
    named = (F.size("_symbols") == 0) | F.array_contains("_symbols", F.col("name")) | F.array_contains("_symbols", F.substring_index("callee", ".", 1))
    there = found(asked.join(linked, "file_path").filter(named).join(heads.select(F.col("file_path").alias("resolved_path"), "name", "node_id"), ["resolved_path", "name"]), 2)
    single = heads.groupBy("name").agg(F.sum("n").alias("n"), F.min("node_id").alias("node_id")).filter("n = 1").drop("n")
    everywhere = found(asked.filter(~is_builtin_method_call(F.col("callee"))).join(single, "name"), 3)
    best = here.unionByName(there).unionByName(everywhere).groupBy(F.col("file_path").alias("_file"), F.col("callee").alias("_callee")).agg(F.min("m").alias("m"))
    # A call without a file still has its name looked up everywhere.
    answered = own.join(best, F.col("file_path").eqNullSafe(F.col("_file")) & (F.col("callee") == F.col("_callee")))
    return answered.groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.node_id").alias("target_id"), F.col("m.tier").alias("tier"))


def cross_links(refs: DataFrame, packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, raw_import, target_id): unresolved imports tied to packages of other workspaces, of which the first (by id) that has a target
    counts. refs: (source_id, workspace_id, raw_import, and kind, if there are others than imports); packages: (package_id, workspace_id, name,
    path); nodes: (node_id, package_id, file_path, start_line). An import of the package itself is looked for in its entry files, and else is the
    package's first symbol. A subpath is looked for as it is, under the package's path and under its src, and else is the first
    file whose path is LIKE it (its own % and _ are wild); no such file, no link."""
    r = refs.filter("kind = 'imports'") if "kind" in refs.columns else refs
    r = r.select("source_id", F.col("workspace_id").alias("own"), "raw_import", specifier_package(F.col("raw_import")).alias("name"), specifier_subpath(F.col("raw_import")).alias("sub"))
    c = r.join(packages, "name").filter(F.col("own") != F.col("workspace_id")).drop("workspace_id")
    root = (F.coalesce("path", F.lit("")) == "") | (F.col("path") == ".")
    under = lambda tail: F.when(root, tail).otherwise(F.concat("path", F.lit("/"), tail))
    ends = [*EXTENSIONS, *["/index" + e for e in EXTENSIONS], ".go"]
    at = lambda base: F.array(*[F.concat(base, F.lit(e)) for e in ends])
    sub = F.col("sub")
    by_sub = F.when(root, at(sub)).otherwise(F.concat(at(sub), at(under(sub)), at(under(F.concat(F.lit("src/"), sub)))))
    tried = F.when(sub == "", F.transform(F.array(*[F.lit(e) for e in ENTRY_FILES]), under)).otherwise(by_sub)
    # Each wanted (package, subpath) is looked for once, however many imports name it.
    wanted = c.select("package_id", "path", "sub").distinct()
    own = nodes.filter("package_id is not null")
    # A file's first symbol stands for it, so a candidate meets one row.
    heads = own.groupBy("package_id", "file_path").agg(F.min(F.struct("start_line", "node_id")).alias("h")).select("package_id", "file_path", F.struct("file_path", "h.start_line", "h.node_id").alias("h"))
    exact = wanted.select("package_id", "sub", F.posexplode(tried).alias("pos", "file_path")).join(heads, ["package_id", "file_path"]).groupBy("package_id", "sub").agg(F.min_by("h", "pos").alias("h"))
    open_ = wanted.join(exact, ["package_id", "sub"], "left_anti")
    first = heads.groupBy("package_id").agg(F.min("h").alias("h"))
    rest = open_.filter("sub = ''").join(first, "package_id").select("package_id", "sub", "h")
    like = open_.filter("sub <> ''").join(heads, "package_id").filter(F.expr("file_path LIKE concat('%', sub, '%')")).groupBy("package_id", "sub").agg(F.min("h").alias("h"))
    found = exact.unionByName(rest).unionByName(like)
    best = c.select("source_id", "raw_import", "package_id", "sub").join(found, ["package_id", "sub"]).groupBy("source_id", "raw_import").agg(F.min_by("h", "package_id").alias("h"))
    return best.select("source_id", "raw_import", F.col("h.node_id").alias("target_id"))


def resolve_cross(refs: DataFrame, packages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, weight): the edges of cross_links()."""
    return cross_links(refs, packages, nodes).select("source_id", "target_id", F.lit("imports").alias("kind"), F.lit(0.5).alias("weight")).distinct()


def open_refs(refs: DataFrame, links: DataFrame) -> DataFrame:
    """refs without those that links resolve; other kinds than imports stay."""
    done = links.select("source_id", "raw_import").distinct()
    if "kind" not in refs.columns:
        return refs.join(done, ["source_id", "raw_import"], "left_anti").select(*refs.columns)
    return refs.join(done.withColumn("kind", F.lit("imports")), ["source_id", "raw_import", "kind"], "left_anti").select(*refs.columns)


def cross_counts(refs: DataFrame, links: DataFrame) -> DataFrame:
    """One row (resolved, still_unresolved, edges)."""
    done = links.select("source_id", "raw_import", F.lit(1).alias("_l"))
    imports = F.col("kind") == "imports" if "kind" in refs.columns else F.lit(True)
    hit = imports & F.col("_l").isNotNull()
    both = refs.join(done, ["source_id", "raw_import"], "left").agg(F.count_if(hit).alias("resolved"), F.count_if(~hit).alias("still_unresolved"))
    return both.join(F.broadcast(links.agg(F.count_distinct("source_id", "target_id").alias("edges"))), how="cross")  # one row each


def node_ids(refs: DataFrame, nodes: DataFrame, name: str = "source") -> DataFrame:
    """refs with node_id: of the node with that qualified name (the least id of several), else the first node of the file with that path, else
    null. nodes: (node_id, qualified_name, file_path, start_line)."""
    by_name = nodes.filter("qualified_name is not null").groupBy(F.col("qualified_name").alias("_k")).agg(F.min("node_id").alias("_by_name"))
    by_file = first_nodes(nodes.select("node_id", "file_path", "start_line")).select(F.col("file_path").alias("_f"), F.col("node_id").alias("_by_file"))
    both = refs.join(by_name, F.col(name) == F.col("_k"), "left").join(by_file, F.col(name) == F.col("_f"), "left")
    return both.select(*refs.columns, F.coalesce("_by_name", "_by_file").alias("node_id"))


def package_pairs_of_files(imports: DataFrame) -> DataFrame:
    """The distinct pairs of package directories of imports (file_path, resolved_path)."""
    return imports.select(package_dir(F.col("file_path")).alias("source_dir"), package_dir(F.col("resolved_path")).alias("target_dir")).filter("source_dir <> '' and target_dir <> '' and source_dir <> target_dir").distinct()


def distinct_types(refs: DataFrame) -> DataFrame:
    """One reference of each function to each type, on its first line; builtin types are dropped."""
    return refs.filter(~F.col("type").isin(TS_BUILTIN_TYPES + GO_BUILTIN_TYPES)).groupBy("source_id", "type").agg(F.min("line_number").alias("line_number"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """Each file's first node by line (null last) and id; combined within tasks."""
    rest = [c for c in nodes.columns if c not in ("file_path", "start_line", "node_id")]
    first = nodes.groupBy("file_path").agg(F.min(F.struct(F.col("start_line").isNull().alias("_none"), "start_line", "node_id", *rest)).alias("_f"))
    return first.select(*[c if c == "file_path" else F.col(f"_f.{c}").alias(c) for c in nodes.columns])
