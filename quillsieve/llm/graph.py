"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import checkpointed


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node with a link to another one; the root is the smallest node of its component.

    Each round is two grouped minima and two joins, so a node with very many
    neighbours is pre-aggregated before the shuffle and its join can be split.
    Self links, repeated links and nulls are ignored; an empty table gives none.
    """
    a, b = F.col(src), F.col(dst)
    edges = checkpointed(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if before == (state.n, state.h):
            break
        before = (state.n, state.h)
        if not state.n:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_min, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("lo").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        edges = checkpointed(
            small.where("e.a <> e.b").select(F.greatest("e.a", "e.b").alias("hi"), F.least("e.a", "e.b").alias("lo")).distinct()
        )
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
