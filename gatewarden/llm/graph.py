"""Connected components by alternating large-star and small-star rounds on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _hang(links: DataFrame) -> DataFrame:
    """Every neighbour above u, and u's smallest neighbour: links (u, v) become (v, min)."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))


def _each(df: DataFrame, names: tuple[str, str], *pairs: tuple[str, str]) -> DataFrame:
    """For every row one row of each pair of columns, in one reading of df (a union would work df out once for each)."""
    return df.select(F.inline(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(pair, names, strict=True))) for pair in pairs))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), root being the smallest node of its component.

    Self links and repeated links change nothing; an empty table gives an empty table. Stars are joined to
    their minimum (map-side minima first), so a node with very many links is never gathered in one task.
    Both halves of a round are written, so that no plan holds more than one of them: in one piece the second half
    works the first out four times over, and the driver holds every exchange of it at once.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = _each(edges, ("u", "v"), ("u", "v"), ("v", "u"))
        large = saved(_hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())  # m <= u < v
        edges = saved(_each(_hang(large), ("u", "v"), ("v", "m"), ("u", "m")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return _each(edges, ("node", "root"), ("u", "v"), ("v", "v")).distinct()
