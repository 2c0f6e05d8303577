"""Settings: defaults, then a mapping (a parsed YAML or JSON file), then environment variables TESSERA_<SECTION>_<KEY>."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping

from ..functions import fixed

DEFAULTS = {
    "indexer": {"max_chunk_tokens": fixed.MAX_CHUNK_TOKENS, "min_chunk_tokens": fixed.MIN_CHUNK_TOKENS, "overlap_tokens": fixed.OVERLAP_TOKENS, "file_extensions": fixed.EXTENSIONS, "exclude_dirs": fixed.EXCLUDED_DIRS, "parser": "patterns"},
    "retrieval": {"default_top_k": 10, "fts_candidate_pool": fixed.POOL, "max_graph_depth": 4, "cache_ttl_seconds": fixed.CACHE_TTL_SECONDS, "use_reranker": False, "reranker_top_k": 10},
    "memory": {"graph_bfs_frontier": fixed.FRONTIER},
    "embedding": {"dims": fixed.DIMS, "quantize": True},
    "context": {"max_tokens": fixed.MAX_CONTEXT_TOKENS},
    "plugins": {"enabled": []},
}


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> dict:
    """A value from the environment is read as JSON if it can be."""
    out = copy.deepcopy(DEFAULTS)
    if path:
        with open(path) as f:
            text = f.read()
        try:
            given = json.loads(text)
        except ValueError:
            import yaml  # only for YAML files

            given = yaml.safe_load(text) or {}
        for section, values in given.items():
            out.setdefault(section, {}).update(values)
    for section, values in out.items():
        for key in values:
            if (raw := env.get(f"TESSERA_{section}_{key}".upper())) is not None:
                try:
                    values[key] = json.loads(raw)
                except ValueError:
                    values[key] = raw
    return out
