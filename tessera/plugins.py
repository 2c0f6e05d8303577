"""Hooks: transforms of the chunk table, of results, and of prompts, run in the order they were registered."""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame


class Plugin:
    def on_chunks(self, chunks: DataFrame) -> DataFrame:
        return chunks

    def on_results(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        return results

    def on_prompt(self, prompt: str) -> str:
        return prompt


class Plugins:
    def __init__(self, names: list[str] | None = None):
        self.loaded: list[Plugin] = []
        for name in names or []:
            try:
                module, _, cls = name.rpartition(".")
                self.loaded.append(getattr(importlib.import_module(module), cls)())
            except Exception:  # a plugin that fails to load is left out
                logging.getLogger(__name__).exception("plugin %s", name)

    def add(self, plugin: Plugin) -> None:
        self.loaded.append(plugin)

    def run(self, hook: str, value, *before):
        for p in self.loaded:
            f: Callable = getattr(p, hook)
            value = f(*before, value)
        return value
