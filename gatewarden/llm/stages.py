"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of docs.

Defined results, for all stages: null and empty texts are documents like others (scored as padding, in no group, free
of hits and of personal data, one closing token); rows without a doc_id or with one that others share are judged by
their own texts; further columns pass through whatever they are called, as they are carried in one column of their
own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, packing, pii, quality
from .common import saved, table

OWN = ("doc_id", "text")


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name of theirs meets one of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("kept"))


def _whole(slim: DataFrame, columns: list[str], recount: bool = False) -> DataFrame:
    """The columns of docs again; n_chars of a text that is not null counted anew where texts have changed."""
    n = F.coalesce(F.char_length("text").cast("long"), F.col("kept.n_chars")) if recount and "n_chars" in columns else None
    return slim.select(*(F.col(c) if c in OWN else (n if c == "n_chars" and n is not None else F.col(f"kept.`{c}`")).alias(c) for c in columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (a score under 0.5) go."""
    net = quality.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _whole(quality.with_quality(_slim(docs), net).where("quality_score >= 0.5"), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id, null last, then the smallest row key.

    The key is a 128-bit code of all columns, so rows without an id or with a shared one are grouped by their own
    texts; rows equal in all columns are one.
    """
    nulls = F.array(*(F.col(f"`{c}`").isNull() for c in docs.columns))  # hashes pass over nulls
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), nulls.alias("nulls")).withColumn("row", F.concat(F.hex(F.xxhash64("d", "nulls")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "d", "nulls"))))
    ids = keyed.select("row", F.struct(F.col("d.doc_id").isNull().alias("none"), "d.doc_id", "row").alias("rank"))
    classes = jaccard.near_classes(keyed.select("row", "d.text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    kept = saved(classes.join(ids, "row").groupBy("component_id").agg(F.min("rank")["row"].alias("row")).select("row"))
    return keyed.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("d.*")


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out of the texts, with the characters between them."""
    found = decontam.contamination(_slim(docs), table(spark, sf_dir, "benchmark"))
    return _whole(decontam.without_hits(found), docs.columns, recount=True)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets."""
    slim = _slim(docs)
    found = pii.with_spans(slim, pii.train(slim)).withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    return _whole(found, docs.columns, recount=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: one row per piece."""
    return packing.packed(docs)
