"""Mixing sources to target weights: hash-threshold histograms instead of a sort. DataFrame functions only.

Every document has a 60-bit hash of its id; a source's budget is met by the documents whose hash lies under the
source's threshold, so a larger budget takes a superset of a smaller one's documents, and a target over the source's
size is so many whole passes and one such part. The threshold is found by digits of 12 bits: words are added up by
(source, digit), map-side first, a running sum over at most 4096 digits finds the one in which the budget ends, and
only the rows of that digit (one in 4096) go on to the next. The last row found is the boundary document: it is taken
up to the word where the budget ends, so a source's taken words are its rounded target exactly.

Targets: the shares of the weights, cut at `most` times a source's size, with the excess shared again by weight until
none is above. The rounds are aggregates over the table of sources, and only two sums a round reach the driver.

Defined results: a null text has no words; a null source is a source of its own, the last one; rows with a shared or
null doc_id are told apart by a hash of their texts, and equal rows by a number that is written down with them, so
that a rerun gives the same rows; documents without words take none; an empty table gives an empty table; further
columns pass through whatever they are called. A very long text is counted by one pass of two patterns.

Scale: texts are read once, for their counts; all else works on a written narrow table (id, source, size, keys). The
table of sources is broadcast only if it has at most SMALL rows, else it is spread over SALTS copies of its rows, so
that a source with a third of all documents is not one task. Sources are numbered by ranges, not in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of a digit, and digits of a key.
BITS, DIGITS = 12, 5
#: Rows of the table of sources up to which it is broadcast, and its copies beyond.
SMALL, SALTS = 10_000, 64
KEYS = ("k1", "k2", "k3")


def n_words(text: Column) -> Column:
    """Runs of characters other than white space: each becomes one letter, then the white space goes."""
    letters = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.char_length(F.regexp_replace(letters, r"[\x20\x09-\x0D]+", "")).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size and the keys of every document, written once: the only pass over texts."""
    first = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    low = lambda c: c.bitwiseAND(F.lit((1 << BITS * DIGITS) - 1))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), first.alias("k1"), low(F.xxhash64("text")).alias("k2"))
    return saved(rows.withColumn("k3", low(F.xxhash64(F.monotonically_increasing_id()))))


def numbered(sources: DataFrame, *order: Column) -> DataFrame:
    """sources with their number from 0 in an order: counted by ranges of it, so no task holds all of them."""
    ranges = saved(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("place", place).join(before.select("range", "before"), "range").withColumn("number", F.col("before") + F.col("place")).drop("range", "place", "before")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target: weights go round the sources in the order of their code points, null last."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = numbered(sizes, F.col("source").isNull(), F.col("source").asc_nulls_last())
    each = saved(each.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("double") for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))).drop("number"))
    cap = F.col("source_size") * most
    total = each.agg(F.sum("source_size")).first()[0] or 0
    level, shares = 0.0, None
    while True:  # the level of a unit of weight only rises, so a source once at its cap stays there
        above = F.col("weight") * level > cap
        capped, open_ = each.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if (capped, open_) == shares:
            break
        shares = (capped, open_)
        level = (total - capped) / open_ if open_ else level
    return each.withColumn("target", F.when(F.col("weight") * level > cap, cap.cast("double")).otherwise(F.col("weight") * level))


def _meet(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of their source, null sources too; `source` and the others are named apart."""
    other = sources.withColumnRenamed("source", "_source")
    if few:
        return rows.join(F.broadcast(other), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")
    salts = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_at", F.pmod(F.col("k3"), F.lit(SALTS)).cast("int"))
    return salted.join(salts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")), how).drop("_source", "_salt", "_at")


def _digit(level: int) -> Column:
    shift = BITS * (DIGITS - 1 - level % DIGITS)
    return F.shiftright(F.col(KEYS[level // DIGITS]), shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def boundaries(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """For each source with a budget (source, rest > 0, under its size): the keys of the document in which the rest
    ends, and the words that are left for it."""
    left, level = rows.where("size > 0"), 0
    while True:
        digits = left.withColumn("digit", _digit(level))
        sums = _meet(digits.groupBy("source", "digit").agg(F.sum("size").alias("words"), F.count("*").alias("n")).withColumn("k3", F.col("digit").cast("long")), budgets, few)
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        ends = sums.withColumn("upto", upto).where("upto >= rest AND upto - words < rest").select("source", F.col("digit").alias("_digit"), "n", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))
        ends = saved(ends)
        # the rows of the digit in which a budget ends, and no others, are looked at again
        left = saved(_meet(digits, ends.drop("rest"), few).where("digit = _digit").select("source", "size", *KEYS))
        budgets, level = ends.select("source", "rest"), level + 1
        if not ends.where("n > 1").limit(1).count() or level == DIGITS * len(KEYS):
            return _meet(left, budgets, few).select("source", *(F.col(k).alias("at_" + k) for k in KEYS), "rest")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (source too)."""
    rows = sized(docs, seed)
    goal = targets(rows, weights, most)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    goal = saved(goal.withColumn("passes", whole.cast("long")).withColumn("rest", budget - F.col("passes") * F.col("source_size")))
    few = goal.count() <= SMALL
    ends = saved(boundaries(rows, goal.where("rest > 0").select("source", "rest"), few))
    own, at = F.struct(*KEYS), F.struct(*("at_" + k for k in KEYS))
    part = F.when(F.col("at_k1").isNull(), 0).when(own < at, F.col("size")).when(own == at, F.col("end_rest")).otherwise(0)
    met = _meet(_meet(rows, goal.drop("rest"), few), ends.withColumnRenamed("rest", "end_rest"), few, "left")
    return met.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source")


#: The same from cumulative sums in the order of the hash; the level by trying every source as the last one at its cap.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, pos) AS rk FROM w),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY rk DESC) AS open_weight, sum(source_size) OVER () AS total FROM r),
l AS (SELECT min_by((total - capped) / open_weight, rk) AS level FROM c WHERE weight * ((total - capped) / open_weight) <= 3 * source_size),
t AS (SELECT source, source_size, least(weight * level, 3.0 * source_size)::DOUBLE AS target FROM c, l),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
o AS (SELECT d.*, source_size, target, budget // greatest(source_size, 1) AS passes, budget - (budget // greatest(source_size, 1)) * source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(size, rest - before), 0) AS BIGINT) AS taken FROM o
"""
