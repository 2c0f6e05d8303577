"""Jobs to run on a cluster: each a function of a session, a command line and a small file of settings."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tessera.jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The job's own settings file beside its module, with what ``path`` has in its place."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")) as f:
        known = json.load(f)
    if path:
        with open(path) as f:
            given = json.load(f)
        if more := set(given) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(more))}")
        known |= given
    return known


def main(name: str, run: Callable[..., dict], *paths: str) -> None:
    """The command line of a job: ``paths`` are its arguments in order. Only here a session is made and ended."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for one in paths:
        p.add_argument(one)
    p.add_argument("--config", help="a file of settings in place of the job's own")
    given = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        print(json.dumps(run(spark, *(given[one] for one in paths), settings(name, given["config"]))))
    finally:
        spark.stop()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import evidence_packs, search_index

    return {"job1_search_index": search_index.query, "job2_evidence_packs": evidence_packs.query}


def oracle_sql() -> dict[str, str]:
    from . import evidence_packs, search_index

    return {"job1_search_index": search_index.SQL, "job2_evidence_packs": evidence_packs.SQL}
