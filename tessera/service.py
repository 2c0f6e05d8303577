"""The engine over HTTP, and reports of results. JSON in and out; errors are {"detail": ..} with a status."""

from __future__ import annotations

import json
import os
import resource
import time
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from .sources import generate

VERSION = "1.0.0"


class Problem(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


class Service:
    """Routes of the service as methods of plain values; ``server`` answers prompts, if there is one."""

    def __init__(self, engine, server: generate.Server | None = None):
        self.engine, self.server = engine, server
        self.routes = {("GET", "/health"): self.health, ("GET", "/stats"): self.stats, ("POST", "/index"): self.index, ("POST", "/query"): self.query, ("POST", "/ask"): self.ask, ("GET", "/projects"): self.projects, ("DELETE", "/project"): self.delete, ("GET", "/graph"): self.graph, ("GET", "/project/meta"): self.meta}

    def health(self) -> dict:
        return {"status": "ok", "version": VERSION}

    def stats(self) -> dict:
        return {"rss_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 2), "projects": len(self.engine.projects()), "version": VERSION}

    def index(self, project_root: str, force_reindex: bool = False) -> dict:
        if "://" not in project_root and not os.path.exists(project_root):
            raise Problem(422, f"there is no folder {project_root}")
        return {"status": "indexed", "stats": self.engine.index(project_root, force_reindex), "project_id": self.engine.registry.project_id(project_root)}

    def query(self, project_root: str, query: str, top_k: int = 10) -> dict:
        began, routed = time.time(), self.engine.route(query)
        hits = self.engine.ask(project_root, query, top_k)
        return {"query": query, "intent": routed["intent"], "confidence": routed["confidence"], "results": hits, "elapsed_ms": int(1000 * (time.time() - began))}

    def ask(self, project_root: str, query: str, top_k: int = 10, stream: bool = False) -> dict | Iterator[str]:
        if self.server is None:
            raise Problem(400, "no language-model server is set")
        prompt = self.engine.prompt(project_root, query, top_k)
        if stream:
            return generate.stream(self.server, prompt)
        return {"query": query, "answer": generate.answer(self.server, prompt), "results": self.engine.ask(project_root, query, top_k)}

    def projects(self) -> list[dict]:
        return self.engine.projects()

    def delete(self, project_root: str) -> dict:
        if not self.engine.delete(project_root):
            raise Problem(404, "no such project")
        return {"status": "deleted", "project_root": project_root}

    def graph(self, project_root: str, depth: int = 2) -> dict:
        edges, nodes = self.engine.graph(project_root)
        edges = [r.asDict() for r in edges.select("from_id", "to_id", "edge_type", "weight").collect()]  # GRAPH_EDGES at most
        return {"nodes": [{"id": r["id"], "label": r["label"], "type": r["chunk_type"]} for r in nodes.collect()], "edges": edges, "total_edges": len(edges)}

    def meta(self, project_root: str) -> dict:
        return self.engine.meta(project_root)

    def call(self, method: str, target: str, body: bytes = b""):
        """The result of a request: (status, a value or an iterator of text)."""
        at = urlsplit(target)
        if (route := self.routes.get((method, at.path))) is None:
            return 404, {"detail": "Not Found"}
        try:
            values = json.loads(body) if body else {k: int(v) if v.lstrip("-").isdigit() else v for k, v in parse_qsl(at.query)}
            return 200, route(**values)
        except Problem as e:
            return e.status, {"detail": str(e)}
        except (TypeError, ValueError) as e:
            return 422, {"detail": str(e)}
        except RuntimeError as e:
            return 400, {"detail": str(e)}
        except Exception as e:
            return 500, {"detail": str(e)}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server that isn't running yet (``serve_forever``); streamed answers are text, sent token by token."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, value = service.call(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            plain = not isinstance(value, dict | list)
            data = None if plain else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if plain else "application/json")
            if data is not None:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if data is not None:
                self.wfile.write(data)
            else:
                for token in value:
                    self.wfile.write(token.encode())
                    self.wfile.flush()

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def report(results: dict[str, list[dict]], most: int = 5) -> str:
    """Markdown: the first results of each query."""
    out = ["# Results", ""]
    for query, hits in results.items():
        out += [f"## {query}", ""]
        for h in hits[:most]:
            out += [f"{h['rank']}. `{h['file_path']}:{h['start_line']}-{h['end_line']}` {h['chunk_type']} {h['name'] or 'n/a'} (score {h['final']:.4f}; lexical {h['lexical']:.4f}, semantic {h['semantic']:.4f}, graph {h['graph']:.4f})"]
        out += ["", *([] if hits else ["No results.", ""])]
    return "\n".join(out)
