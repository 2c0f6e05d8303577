"""Sinks for prompts: language-model servers over HTTP, whole answers or tokens as they come, one prompt or a table of them."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Server:
    """Where prompts go: a kind of KINDS, the server's address, its model, and the environment variable with a key, if it wants one."""

    kind: str
    url: str
    model: str = ""
    key_variable: str = ""
    seconds: float = 300


def _chat(model: str, prompt: str, stream: bool) -> dict:
    return {"model": model, "messages": [{"role": "system", "content": "Answer questions about the source code that is quoted to you."}, {"role": "user", "content": prompt}], "stream": stream}


#: For each kind of server: its path, the body of a request, the text in a whole answer, and that in a part of a streamed one.
KINDS: dict[str, tuple[str, Callable, Callable, Callable]] = {
    "ollama": ("/api/generate", lambda m, p, s: {"model": m, "prompt": p, "stream": s}, lambda a: a.get("response", ""), lambda a: a.get("response")),
    "llamacpp": ("/completion", lambda m, p, s: {"prompt": p, "stream": s}, lambda a: a.get("content") or a.get("response", ""), lambda a: a.get("content") or a.get("response")),
    "openai": ("/v1/chat/completions", _chat, lambda a: a["choices"][0]["message"]["content"], lambda a: a["choices"][0]["delta"].get("content")),
}


def tokens(kind: str, lines: Iterable[bytes]) -> Iterator[str]:
    """The text in a streamed answer: JSON lines, or server-sent events up to [DONE]. Lines that aren't JSON are passed over."""
    part = KINDS[kind][3]
    for line in lines:
        data = line.decode("utf-8", "replace").strip().removeprefix("data:").strip()
        if data == "[DONE]":
            return
        try:
            found = part(json.loads(data))
        except (ValueError, KeyError, IndexError, AttributeError):
            continue
        if found:
            yield found


def _open(server: Server, prompt: str, stream: bool):
    path, body, _, _ = KINDS[server.kind]
    head = {"Content-Type": "application/json"}
    if server.key_variable:
        if not os.environ.get(server.key_variable):
            raise RuntimeError(f"{server.key_variable} is not set")
        head["Authorization"] = f"Bearer {os.environ[server.key_variable]}"
    return urlopen(Request(server.url.rstrip("/") + path, json.dumps(body(server.model, prompt, stream)).encode(), head), timeout=server.seconds)


def answer(server: Server, prompt: str) -> str:
    with _open(server, prompt, False) as r:
        return KINDS[server.kind][2](json.load(r))


def stream(server: Server, prompt: str) -> Iterator[str]:
    """The answer's tokens as they come."""
    with _open(server, prompt, True) as r:
        yield from tokens(server.kind, r)


def answers(prompts: DataFrame, server: Server, key: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """(key, answer) for a table of prompts; each task asks for its rows one after the other. A failed request gives a null answer."""

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf[prompt]:
                try:
                    out.append(answer(server, p))
                except (OSError, ValueError, KeyError):
                    out.append(None)
            yield pdf[[key]].assign(answer=out)

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, answer string")
