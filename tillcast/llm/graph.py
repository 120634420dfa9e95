"""Connected components of a graph that no machine could hold."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import written


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``component`` (smallest reachable node) for every node in ``links`` (a, b).

    Alternates two steps until nothing changes: nodes hand the smallest of their neighbours to
    their larger neighbours, then to their smaller ones. Each step is a grouped minimum, combined
    before the shuffle, and a join whose large keys Spark may split. Steps are written below ``folder``.
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{folder}/edges-0",
    )
    state = _state(edges)
    for step in itertools.count(1):
        edges = written(_to_smaller(_to_larger(edges)), f"{folder}/edges-{step}")
        before, state = state, _state(edges)
        if state == before:
            break
    # Every larger node now hangs on the smallest of its component.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(a * 31 + b)")).first()
    )


def _to_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return (
        _with_hash(both)
        .join(_with_hash(least), ["a", "hash"])
        .where("b > a AND b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _to_smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = (
        _with_hash(edges)
        .join(_with_hash(least), ["a", "hash"])
        .where("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
    )
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64("a"))
