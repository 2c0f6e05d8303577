"""API calls and dependency edges in chunks, by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import each
from .graph import candidates, distinct_edges, resolve


def api_calls(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, method, endpoint, client_type, is_dynamic): of a chunk's calls with one method and endpoint that of the first rule."""
    t = F.col(text)
    take = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))

    def calls(methods, ends, client: str, dynamic: bool):
        one = lambda m, e: F.struct(F.upper(F.coalesce(F.nullif(m, F.lit("")), F.lit("GET"))).alias("method"), e.alias("endpoint"), F.lit(client).alias("client_type"), F.lit(dynamic).alias("is_dynamic"))
        return F.transform(ends, lambda e: one(F.lit("GET"), e)) if methods is None else F.zip_with(methods, ends, one)

    template, base = F.transform(take(fixed.FETCH_TEMPLATE, 1), lambda e: F.concat(e, F.lit("*"))), F.transform(take(fixed.BASE_URL, 1), lambda e: F.concat(e, F.lit("/*")))
    rules = [
        calls(take(fixed.FETCH, 2), take(fixed.FETCH, 1), "fetch", False),
        calls(None, template, "fetch", True),
        calls(take(fixed.AXIOS, 1), take(fixed.AXIOS, 2), "axios", False),
        calls(None, take(fixed.USE_QUERY, 1), "useQuery", False),
        calls(None, base, "rtk", True),
    ]
    every = chunks.select(key, F.posexplode_outer(F.concat(*rules)).alias("n", "c")).where("c IS NOT NULL")  # as text.each
    first = every.groupBy(key, F.col("c.method").alias("method"), F.col("c.endpoint").alias("endpoint")).agg(F.min_by("c", "n").alias("c"))
    return first.select(key, "method", "endpoint", "c.client_type", "c.is_dynamic")


def resolved_specifiers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, specifier, to_id): relative specifiers joined to the importing file's folder, with the extensions and index files they may stand for."""
    parts = F.split(F.concat_ws("/", F.col("folder"), F.col("specifier")), "/")
    path = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1))).otherwise(F.concat(s, F.array(p))), lambda s: F.array_join(s, "/"))
    relative = imports.where(F.col("specifier").startswith("."))
    own = relative.join(files.select(F.col("id").alias("file_id"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")), "file_id").withColumn("base", path)
    ends = ["", *[f".{e}" for e in fixed.EXTENSIONS], *[f"/index.{e}" for e in fixed.EXTENSIONS]]
    tried = own.select("file_id", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ends])).alias("n", "path")).join(files.select("path", F.col("id").alias("to_id")), "path")
    return tried.groupBy("file_id", "specifier").agg(F.min_by("to_id", "n").alias("to_id"))


def import_targets(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(from_id, to_id) of imports (file_id, specifier)."""
    return resolved_specifiers(files, imports).select(F.col("file_id").alias("from_id"), "to_id")


def parts(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, part, name): the state that a chunk keeps (names of pairs, or of what a reducer gives), contexts it makes or uses, and handlers it sets."""
    found = lambda part, p: F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))), lambda x: F.struct(F.lit(part).alias("part"), x.alias("name")))
    every = F.concat(
        found("state", r"\[\s*(\w+)\s*,\s*\w+\s*\]\s*=\s*(?:React\.)?use(?:State|Reducer)\b"), found("context", r"\buseContext\(\s*(\w+)"),
        found("provider", r"(\w+)\s*=\s*(?:React\.)?createContext\b"), found("handler", r"\b(on[A-Z]\w*)\s*=\s*\{"),
    )
    return each(chunks, [key], every, "x").select(key, "x.part", "x.name")


def mentions(chunks: DataFrame, only: str | None = None) -> DataFrame:
    """(chunk_id, file_id, kind, name, path) from chunks (id, file_id, chunk_type, text): what a chunk imports (IMPORTS), the hooks, contexts and tags in
    it, components of its routes (DEFINES_ROUTE, with the route's path), and whether it has state. All that edges need of texts, so texts are searched once; with ``only`` for that kind alone."""
    t, of = F.col("text"), F.col("chunk_type")
    code = of != "IMPORT_BLOCK"
    none = F.array().cast("array<struct<kind:string,name:string,path:string>>")
    wanted = lambda kind: only in (None, kind)
    found = lambda kind, p: F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(1))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"), F.lit(None).cast("string").alias("path"))) if wanted(kind) else none
    routes = F.zip_with(F.regexp_extract_all(t, F.lit(fixed.ROUTE), F.lit(1)), F.regexp_extract_all(t, F.lit(fixed.ROUTE), F.lit(2)), lambda p, n: F.struct(F.lit("DEFINES_ROUTE").alias("kind"), n.alias("name"), p.alias("path"))) if wanted("DEFINES_ROUTE") else none
    state = none if not wanted("MANAGES_STATE") else F.when(t.rlike(fixed.USE_STATE), F.array(F.struct(F.lit("MANAGES_STATE").alias("kind"), F.lit("").alias("name"), F.lit(None).cast("string").alias("path")))).otherwise(none)
    of_code = F.concat(found("USES_HOOK", fixed.EDGE_HOOK), found("CONSUMES_CONTEXT", fixed.USE_CONTEXT), F.when(of.isin("COMPONENT", "FUNCTION"), found("RENDERS", fixed.EDGE_TAG)).otherwise(none), routes, state)
    rows = each(chunks, [F.col("id").alias("chunk_id"), "file_id"], F.when(code, of_code).otherwise(found("IMPORTS", fixed.IMPORT_FROM)), "x")
    return rows.select("chunk_id", "file_id", "x.kind", "x.name", "x.path")


def resolved_routes(chunks: DataFrame, symbols: DataFrame, said: DataFrame) -> DataFrame:
    """(name, chunk, file_id, path, target) of the routes among ``mentions``."""
    found = said.where("kind = 'DEFINES_ROUTE'").select(F.col("chunk_id").alias("chunk"), "file_id", "path", "name")
    return resolve(found, candidates(chunks, symbols, ["COMPONENT", "HOOK", "FUNCTION"], True))


def routes_of(found: DataFrame) -> DataFrame:
    routes = found.groupBy("path", F.col("name").alias("component")).agg(F.min("target").alias("chunk_id"))
    return routes.select(F.sha1(F.concat_ws(":", "path", "component")).alias("id"), "path", "component", "chunk_id", F.lit(False).alias("is_protected"), F.lit(None).cast("string").alias("parent_route"), F.lit(None).cast("string").alias("metadata"))


def edges_and_routes(files: DataFrame, chunks: DataFrame, symbols: DataFrame, compat: bool = False, keep_state: bool | None = None, said: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (from_id, to_id, edge_type, weight) and routes of all chunks: a function of the current tables, whatever the order files came in. ``said`` is what
    ``mentions`` found in the chunks, if it is kept. A chunk with state has an edge to itself (``keep_state``; not with ``compat``, which drops such edges)."""
    keep_state = not compat if keep_state is None else keep_state
    every = mentions(chunks) if said is None else said
    of = lambda kind: every.where(F.col("kind") == kind)

    def linked(kinds: list[str], kind: str) -> DataFrame:
        found = of(kind).select(F.col("chunk_id").alias("from_id"), "name")
        return resolve(found, candidates(chunks, symbols, kinds, True)).select("from_id", F.col("target").alias("to_id"), F.lit(kind).alias("edge_type"), F.lit(fixed.EDGE_WEIGHTS[kind]).alias("weight"))

    specs = of("IMPORTS").select("file_id", F.col("name").alias("specifier")).where(F.col("specifier").startswith("."))
    targets = specs.select(F.col("file_id").alias("from_id"), F.sha1("specifier").alias("to_id")) if compat else import_targets(files, specs)
    edges = targets.select("from_id", "to_id", F.lit("IMPORTS").alias("edge_type"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(linked(["HOOK"], "USES_HOOK")).unionByName(linked([], "CONSUMES_CONTEXT")).unionByName(linked(["COMPONENT"], "RENDERS"))

    main = chunks.where("chunk_type = 'COMPONENT'").groupBy("file_id").agg(F.min_by("id", F.struct("start_line", "id")).alias("main"))
    target = resolved_routes(chunks, symbols, every)
    found = target.join(main, "file_id", "left")
    for source, weight in ((F.coalesce("main", "chunk"), fixed.ROUTE_WEIGHTS[0]), (F.col("chunk"), fixed.ROUTE_WEIGHTS[1])):
        edges = edges.unionByName(found.select(source.alias("from_id"), F.col("target").alias("to_id"), F.lit("DEFINES_ROUTE").alias("edge_type"), F.lit(weight).alias("weight")))
    # by themselves routes need no other pattern
    routes = routes_of(target if said is not None else resolved_routes(chunks, symbols, mentions(chunks, "DEFINES_ROUTE")))
    order = F.col("weight") if compat else -F.col("weight")
    out = distinct_edges(edges.withColumn("_o", order), ["_o"]).drop("_o")
    if keep_state:
        state = of("MANAGES_STATE").select(F.col("chunk_id").alias("from_id"), F.col("chunk_id").alias("to_id"), F.lit("MANAGES_STATE").alias("edge_type"), F.lit(fixed.EDGE_WEIGHTS["MANAGES_STATE"]).alias("weight"))
        out = out.unionByName(state)
    return out.withColumn("metadata", F.lit(None).cast("string")), routes
