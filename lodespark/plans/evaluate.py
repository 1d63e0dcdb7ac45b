"""Backends of the engine compared on judged queries."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.api import Engine
from lodespark.operators import metrics
from lodespark.plans.hybrid import Options

BACKENDS = {
    "bm25": lambda e, q, n, c: e.search_lex(q, n, c),
    "vector": lambda e, q, n, c: e.search_vector(q, n, c, 0.0),
    "hybrid": lambda e, q, n, c: e.search(q, c, Options(limit=n, skip_rerank=True)),
    "full": lambda e, q, n, c: e.search(q, c, Options(limit=n)),
}


def compare(engine: Engine, queries: list[dict], collections: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of each backend and query, and their averages.

    ``queries``: ``id, query, expected_files`` and optionally ``expected_in_top_k`` (10). A backend that fails on a query scores 0 on it.
    """
    spark, out = engine.spark, None
    for name, run in BACKENDS.items():
        found, took = [], []
        for q in queries:
            began = time.perf_counter()
            try:
                files = [r["file"] for r in run(engine, q["query"], max(10, q.get("expected_in_top_k", 10)), collections)]
            except ValueError:
                files = []
            took.append((q["id"], (time.perf_counter() - began) * 1000))
            found += [(q["id"], f, i) for i, f in enumerate(files, 1)]
        results = spark.createDataFrame(found, "query_id string, file string, rank int")
        expected = spark.createDataFrame([(q["id"], f) for q in queries for f in q["expected_files"]], "query_id string, file string")
        times = spark.createDataFrame(took, "query_id string, latency_ms double")
        part = metrics.score_results(results, expected, 10, suffixes=True).join(times, "query_id").withColumn("backend", F.lit(name))
        out = part if out is None else out.unionByName(part)
    averages = metrics.macro_average(out, ["backend"]).join(out.groupBy("backend").agg(F.avg("latency_ms").alias("latency_ms")), "backend")
    return out, averages


def compare_file(engine: Engine, path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        fixture = json.load(f)
    _, averages = compare(engine, fixture["queries"], [fixture["collection"]] if fixture.get("collection") else None)
    return [r.asDict() for r in averages.orderBy("backend").collect()]
