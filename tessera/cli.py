"""python -m tessera.cli index|search|prompt|answer|report|graph|list|meta|delete|watch|serve ..."""

from __future__ import annotations

import argparse
import json

from . import service
from .session import session
from .sources import generate


def main(argv: list[str] | None = None) -> int:
    from .engine import Engine

    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--folder", default="tessera-data", help="where the projects' tables are")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in (("index", ["--force"]), ("search", ["query", "--top-k"]), ("prompt", ["query", "--top-k"]), ("graph", []), ("answer", ["query", "--top-k"]), ("report", ["query", "--top-k"]), ("meta", []), ("delete", []), ("watch", [])):
        s = sub.add_parser(name)
        s.add_argument("root")
        for m in more:
            s.add_argument(m, **({"action": "store_true"} if m == "--force" else {"type": int, "default": 5} if m == "--top-k" else {}))
    sub.add_parser("list")
    sub.add_parser("serve").add_argument("--port", type=int, default=8765)
    p.add_argument("--server", default="ollama", choices=generate.KINDS)
    p.add_argument("--server-url", default="http://127.0.0.1:11434")
    p.add_argument("--model", default="")
    p.add_argument("--key-variable", default="", help="environment variable with the server's key")
    a = p.parse_args(argv)
    engine, server = Engine(session(), a.folder), generate.Server(a.server, a.server_url, a.model, a.key_variable)
    if a.command == "index":
        print(json.dumps(engine.index(a.root, a.force)))
    elif a.command == "search":
        for r in engine.ask(a.root, a.query, a.top_k):
            print(f"{r['rank']}. {r['file_path']}:{r['start_line']}-{r['end_line']} {r['chunk_type']} {r['name'] or ''} {r['final']}")
    elif a.command == "prompt":
        print(engine.prompt(a.root, a.query, a.top_k))
    elif a.command == "answer":
        for token in generate.stream(server, engine.prompt(a.root, a.query, a.top_k)):
            print(token, end="", flush=True)
        print()
    elif a.command == "report":
        print(service.report({a.query: engine.ask(a.root, a.query, a.top_k)}))
    elif a.command == "serve":
        service.serve(service.Service(engine, server), port=a.port).serve_forever()
    elif a.command == "graph":
        engine.edge_counts(a.root).show()
    elif a.command == "meta":
        print(json.dumps(engine.meta(a.root)))
    elif a.command == "delete":
        print(engine.delete(a.root))
    elif a.command == "watch":
        from .streaming.watch import follow

        follow(engine, a.root).awaitTermination()
    else:
        print(json.dumps(engine.projects()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
