"""Indexing and searching a small project, end to end."""

import hashlib
import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from project import FILES
from tessera import service
from tessera.engine import Engine
from tessera.operators import intent
from tessera.plans import search
from tessera.sources import config, generate


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    return at


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory, root):
    e = Engine(spark, str(tmp_path_factory.mktemp("tables")))
    e.first = e.index(str(root))
    return e


def test_index_counts_and_excludes(engine, root):
    store = engine.registry.store(str(root))
    assert engine.first["files_scanned"] == engine.first["files_indexed"] == 7
    rows = {r.path: r for r in store.read("files").collect()}
    assert set(rows) == {p for p in FILES if not p.startswith("node_modules")}
    kinds = {p: r.file_type for p, r in rows.items()}
    assert (kinds["src/hooks/usePantry.ts"], kinds["src/pages/WeekPlan.tsx"], kinds["src/Kitchen.tsx"], kinds["src/lib/portions.js"]) == ("HOOK", "PAGE", "UTIL", "UTIL")
    for p, r in rows.items():
        data = FILES[p].encode()
        assert (r.content_hash, r.size_bytes, r.line_count) == (hashlib.sha256(data).hexdigest(), len(data), FILES[p].count("\n") + 1)


def test_chunks(engine, root):
    store = engine.registry.store(str(root))
    path = {r.id: r.path for r in store.read("files").collect()}
    got = sorted((path[r.file_id], r.chunk_type, r["name"] or "", r.start_line) for r in store.read("chunks").collect())
    assert engine.first["chunks_indexed"] == len(got)
    want = [
        ("src/Kitchen.tsx", "COMPONENT", "Kitchen", 4), ("src/Kitchen.tsx", "IMPORT_BLOCK", "", 1),
        ("src/components/RecipeCard.jsx", "COMPONENT", "RecipeCard", 3), ("src/components/RecipeCard.jsx", "IMPORT_BLOCK", "", 1),
        ("src/contexts/SeasonContext.ts", "COMPONENT", "SeasonContext", 1),
        ("src/hooks/usePantry.ts", "FUNCTION", "refill", 8), ("src/hooks/usePantry.ts", "HOOK", "usePantry", 6), ("src/hooks/usePantry.ts", "IMPORT_BLOCK", "", 1),
        ("src/labels.js", "MISC", "", 1),
        ("src/lib/portions.js", "FUNCTION", "scalePortions", 1), ("src/lib/portions.js", "FUNCTION", "totalGrams", 7),
        ("src/pages/WeekPlan.tsx", "COMPONENT", "WeekPlan", 4), ("src/pages/WeekPlan.tsx", "IMPORT_BLOCK", "", 1),
    ]
    assert got == want


def test_edges_routes_and_calls(engine, root):
    store = engine.registry.store(str(root))
    path, chunk = {r.id: r.path for r in store.read("files").collect()}, {r.id: r["name"] for r in store.read("chunks").collect()}
    label = lambda i: chunk.get(i) or path.get(i)
    edges = {(label(r.from_id), label(r.to_id), r.edge_type) for r in store.read("graph_edges").collect()}
    assert {e for e in edges if e[2] == "IMPORTS"} == {
        ("src/components/RecipeCard.jsx", "src/hooks/usePantry.ts", "IMPORTS"), ("src/pages/WeekPlan.tsx", "src/components/RecipeCard.jsx", "IMPORTS"),
        ("src/pages/WeekPlan.tsx", "src/lib/portions.js", "IMPORTS"), ("src/Kitchen.tsx", "src/pages/WeekPlan.tsx", "IMPORTS"),
    }
    assert {("RecipeCard", "usePantry", "USES_HOOK"), ("WeekPlan", "SeasonContext", "CONSUMES_CONTEXT"), ("WeekPlan", "RecipeCard", "RENDERS"), ("Kitchen", "WeekPlan", "RENDERS"), ("Kitchen", "WeekPlan", "DEFINES_ROUTE"), ("usePantry", "usePantry", "MANAGES_STATE")} <= edges
    assert {r.edge_type: r["n"] for r in engine.edge_counts(str(root)).collect()} == Counter(r.edge_type for r in store.read("graph_edges").collect())
    assert {(r.path, r.component) for r in store.read("routes").collect()} == {("/week", "WeekPlan"), ("/today", "WeekPlan")}
    assert {("GET", "/kitchen/stock", "fetch"), ("POST", "/kitchen/stock", "axios")} <= {(r.method, r.endpoint, r.client_type) for r in store.read("api_calls").collect()}
    assert {"usePantry", "RecipeCard", "WeekPlan", "Kitchen", "totalGrams"} <= {r.name for r in store.read("symbols").collect()}
    exported = {r.name: r.is_exported for r in store.read("symbols").where("symbol_type = 'FUNCTION'").collect()}
    assert exported["totalGrams"] and not exported["refill"]


def test_search_cache_and_prompt(engine, root):
    hits = engine.ask(str(root), "where is usePantry defined?", 5)
    assert ("src/hooks/usePantry.ts", "usePantry") in [(h["file_path"], h["name"]) for h in hits[:3]]
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert all(0 <= h["semantic"] <= 1.000001 and h["final"] <= 1 for h in hits)
    assert engine.ask(str(root), "where is usePantry defined?", 5) == hits and engine.ask(str(root), "where is usePantry defined?", 5) == hits
    store = engine.registry.store(str(root))
    assert store.read("retrieval_cache").first().hit_count == 2
    store.remember("other", [1])  # a write adds the hits up
    assert {r.query_hash: r.hit_count for r in store.read("retrieval_cache").collect()}["other"] == 0 and store.read("retrieval_cache").agg({"hit_count": "sum"}).first()[0] == 2
    prompt = engine.prompt(str(root), "how do portions change with guests", 3)
    assert prompt.startswith("User question:\nhow do portions change with guests\n\nEvidence:\n") and "Score: " in prompt
    assert prompt.rstrip().endswith("line numbers when relevant.")


def test_files_without_declarations_are_found(engine, root):
    assert engine.ask(str(root), "cinnamon", 3)[0]["file_path"] == "src/labels.js"


def test_graph_reaches_what_a_route_needs(engine, root):
    hits = engine.ask(str(root), "which files affect the /week page", 10)
    assert any(h["graph"] > 0 for h in hits)


def test_settings_reach_the_search(spark, engine, root):
    from tessera.plans.search import SearchConfig

    c = SearchConfig.of(config.load(env={"TESSERA_RETRIEVAL_FTS_CANDIDATE_POOL": "3", "TESSERA_MEMORY_GRAPH_BFS_FRONTIER": "2", "TESSERA_RETRIEVAL_MAX_GRAPH_DEPTH": "0"}))
    assert (c.pool, c.frontier, c.most_depth) == (3, 2, 0)
    flat = search.search(engine.registry.store(str(root)), intent.route(engine._one("which files affect the /week page")), 20, engine.encode, c)
    assert all(r.graph == 0 for r in flat.collect())


def test_vectors_as_they_are_and_other_dimensions(spark, tmp_path, root):
    settings = config.load(env={"TESSERA_EMBEDDING_QUANTIZE": "false", "TESSERA_EMBEDDING_DIMS": "32"})
    e = Engine(spark, str(tmp_path / "t"), settings)
    e.index(str(root))
    rows = e.registry.store(str(root)).read("embeddings").collect()
    assert all(r.q is None and len(r.vector) == 32 for r in rows)
    assert e.ask(str(root), "totalGrams", 1)[0]["name"] == "totalGrams"


def test_only_changes_are_indexed_and_deletions_are_seen(engine, root):
    from tessera.streaming import watch

    assert engine.index(str(root))["files_indexed"] == 0 and not watch.stale(engine, str(root))
    (root / "src/Kitchen.tsx").write_text(FILES["src/Kitchen.tsx"] + "\n// changed\n")
    (root / "src/lib/portions.js").unlink()
    assert watch.stale(engine, str(root))
    watch.follow(engine, str(root), once=True).awaitTermination(120)
    assert not watch.stale(engine, str(root))
    names = {r.name for r in engine.registry.store(str(root)).read("chunks").collect()}
    assert "Kitchen" in names and "totalGrams" not in names
    assert engine.registry.store(str(root)).read("retrieval_cache").count() == 0
    os.utime(root / "src/labels.js", (1, 1))  # another time, the same contents
    assert engine.index(str(root))["files_indexed"] == 0 and not watch.stale(engine, str(root))


def test_service_over_http(engine, root):
    """The routes, with a language-model server of the test's own."""

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            for part in (["flour", " and ", "salt"] if asked["stream"] else ["flour and salt"]):
                self.wfile.write(json.dumps({"response": part}).encode() + b"\n")

        def log_message(self, *_):
            pass

    model = HTTPServer(("127.0.0.1", 0), Model)
    made = service.Service(engine, generate.Server("ollama", f"http://127.0.0.1:{model.server_port}", "m"))
    web = service.serve(made, port=0)
    for s in (model, web):
        threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        try:
            with urlopen(Request(f"http://127.0.0.1:{web.server_port}{path}", json.dumps(body).encode() if body else None, method=method), timeout=120) as r:
                data = r.read().decode()
                return r.status, json.loads(data) if r.headers["Content-Type"] == "application/json" else data
        except HTTPError as e:
            return e.code, json.loads(e.read())

    asked = {"project_root": str(root), "query": "how does the pantry work", "top_k": 2}
    assert call("GET", "/health") == (200, {"status": "ok", "version": "1.0.0"})
    assert call("GET", "/stats")[1]["projects"] == 1
    status, found = call("POST", "/query", asked)
    assert status == 200 and found["intent"] == "architecture" and len(found["results"]) == 2
    assert call("POST", "/ask", asked)[1]["answer"] == "flour and salt"
    assert call("POST", "/ask", asked | {"stream": True}) == (200, "flour and salt")
    assert call("GET", f"/graph?project_root={root}")[1]["total_edges"] > 3
    assert call("GET", f"/project/meta?project_root={root}")[1]["files"] == "6"
    assert call("GET", "/projects")[1][0]["project_id"] == engine.registry.project_id(str(root))
    assert call("POST", "/index", {"project_root": "/no/such/folder"})[0] == 422
    assert call("POST", "/query", asked | {"query": ""})[0] == 422
    assert call("DELETE", "/project?project_root=/none")[0] == 404 and call("GET", "/none")[0] == 404
    text = service.report({"how does the pantry work": found["results"], "nothing": []})
    assert text.startswith("# Results") and "1. `src/" in text and "No results." in text
    batch = generate.answers(engine.spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, prompt string"), made.server)
    assert {(r.query_id, r.answer) for r in batch.collect()} == {(1, "flour and salt"), (2, "flour and salt")}
    for s in (model, web):
        s.shutdown()


def test_streams_of_tokens():
    sse = [b'data: {"choices": [{"delta": {"content": "a"}}]}', b"", b"data: oops", b'data: {"choices": [{"delta": {}}]}', b'data: {"choices": [{"delta": {"content": "b"}}]}', b"data: [DONE]", b'data: {"choices": [{"delta": {"content": "c"}}]}']
    assert "".join(generate.tokens("openai", sse)) == "ab"
    assert "".join(generate.tokens("llamacpp", [b'data: {"content": "x"}', b'{"response": "y"}'])) == "xy"


def test_registry_meta_and_delete(engine, root):
    assert engine.meta(str(root))["files"] == "6"
    (p,) = engine.projects()
    assert p["exists"] and p["size_bytes"] > 0
    nodes = engine.graph(str(root))[1]
    assert nodes.count() > 0
    assert engine.delete(str(root)) and not engine.delete(str(root)) and engine.projects() == []


@pytest.mark.parametrize("query", ["", "x" * 1001])
def test_queries_are_checked(engine, root, query):
    with pytest.raises(ValueError):
        engine.ask(str(root), query)


def test_intents(spark):
    from tessera.functions.vectors import hashed_encoder

    asked = {
        "locate the oven timer": "symbol_lookup", "give me an overview of the pantry": "architecture", "which files affect the /week page": "route_tracing",
        "what depends on usePantry": "impact_analysis", "there is a bug in the shopping list": "debugging", "how can I integrate a barcode scanner": "modification_guidance", "plain words only": "architecture",
    }
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {r.query: r.intent for r in intent.route(q).collect()}
    assert got == asked
    from tessera.functions.vectors import hashed_encoder

    near = spark.createDataFrame([(0, "unnecessary render of cards")], "query_id long, query string")
    assert intent.route(near, encode=hashed_encoder).first().intent == "rerender_analysis"
    assert intent.route(near, override="debugging").first().intent == "debugging"
