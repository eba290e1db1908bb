"""Keyword patterns per request; no shuffle before the counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import FLAGS, clauses, fold, may_match, matches
from ..functions.patterns import KEYWORDS, SCANNING
from ..functions.text import url_decode_text

TEXTS = ("request_line", "user_agent", "referer")
TITLES = {"sql_injection": "Sql Injection", "command_execution": "Command Execution", "xss": "Xss"}


def unpivot_targets(entries: DataFrame) -> DataFrame:
    """One row for each non-empty text field of an entry: field, text."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in TEXTS))
    return entries.withColumn("x", F.explode(fields)).select(*entries.columns, "x.field", "x.text").where("text <> ''")


def _first(text: Column, folded: Column, group: str) -> Column:
    """The first pattern of a group in its order that matches; a pattern is run only where its literals are."""
    out = F
    for pattern, score in KEYWORDS[group]:
        hit = F.struct(F.lit(group).alias("pattern_type"), F.lit(pattern).alias("pattern"), F.lit(score).alias("risk_score"), F.regexp_extract(text, FLAGS + pattern, 0).alias("matched_text"))
        out = out.when(matches(text, folded, pattern), hit)
    return out


def candidates(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """The entries whose texts, raw or decoded, hold together what some pattern requires: the others need no pattern.

    The texts go through an explode of one element: the folded text is put together once and sought in by compiled
    code, and what is made of the texts later cannot be moved before this filter.
    """
    raw = [F.col(f) for f in TEXTS]
    seen = fold(F.concat_ws("\n", *raw, *(F.when(c.contains("%"), url_decode_text(c)) for c in raw)))
    held = entries.withColumn("_x", F.explode(F.array(F.struct(seen.alias("seen"), *raw))))
    near = held.where(reduce(or_, (may_match(F.col("_x.seen"), p) for p in patterns)))
    return near.select(*(F.col(f"_x.{c}").alias(c) if c in TEXTS else F.col(f"`{c}`") for c in entries.columns))


def hits_in(groups=tuple(KEYWORDS)) -> Column:
    """What the text fields of an entry hit: at most one pattern for each field and group, in their order."""

    def of_field(field: str) -> Column:
        decoded = url_decode_text(F.col(field))
        texts = F.array(F.struct(decoded.alias("text"), fold(decoded).alias("folded")))
        hits = F.transform(texts, lambda x: F.array_compact(F.array(*(_first(x["text"], x["folded"], g) for g in groups))))[0]
        found = F.transform(hits, lambda h: F.struct(F.lit(field).alias("field"), h.alias("hit"), F.substring(decoded, 1, 200).alias("decoded_text"), F.substring(F.col(field), 1, 200).alias("original_text")))
        return F.when(F.col(field) != "", found)

    return F.flatten(F.array_compact(F.array(*(of_field(f) for f in TEXTS))))


def findings_of(rows: DataFrame) -> DataFrame:
    """rows with `hits` as findings, one for each."""
    hits = rows.withColumn("x", F.explode("hits"))
    kind = F.col("x.hit.pattern_type")
    title = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))[kind]
    return hits.select(
        *(c for c in rows.columns if c != "hits"), "x.field", kind.alias("pattern_type"), "x.hit.pattern", "x.hit.risk_score", "x.hit.matched_text",
        F.concat(F.lit("Keyword Match - "), title).alias("finding_type"),
        F.concat(F.lit("Detected "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" pattern in "), "x.field", F.lit(": '"), "x.hit.matched_text", F.lit("'")).alias("description"),
        "x.decoded_text", "x.original_text",
    )


def keyword_findings(entries: DataFrame, groups=tuple(KEYWORDS)) -> DataFrame:
    """At most one finding per entry, field and group."""
    near = candidates(entries, [p for g in groups for p, _ in KEYWORDS[g]])
    return findings_of(near.withColumn("hits", hits_in(groups)).where("size(hits) > 0"))


def keyword_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern_type", "field").agg(F.count("*").alias("n"))


def pattern_selectivity(entries: DataFrame) -> DataFrame:
    """kind, pattern, literals, texts, picked, matched of every pattern: the texts, those that hold what the pattern
    requires (on which it is run), and those that it matches. Keywords look at decoded texts, signatures at raw ones."""
    targets = unpivot_targets(entries).select("text")
    rows = targets.select(F.explode(F.array(F.struct(F.lit(True).alias("decoded"), url_decode_text(F.col("text")).alias("text")), F.struct(F.lit(False).alias("decoded"), "text"))).alias("x")).select("x.*").withColumn("folded", fold(F.col("text")))
    every = [(kind, p, True) for kind in KEYWORDS for p, _ in KEYWORDS[kind]] + [("scanning", p, False) for p, _ in SCANNING]
    counts = []
    for k, (_, p, decoded) in enumerate(every):
        of = F.col("decoded") == decoded
        counts += [F.count_if(of & may_match(F.col("folded"), p)).alias(f"picked{k}"), F.count_if(of & matches(F.col("text"), F.col("folded"), p)).alias(f"matched{k}")]
    sums = rows.agg(F.count_if("decoded").alias("texts"), *counts)
    lines = [F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("pattern"), F.lit(" & ".join("|".join(c) for c in clauses(p))).alias("literals"), "texts", F.col(f"picked{k}").alias("picked"), F.col(f"matched{k}").alias("matched")) for k, (kind, p, _) in enumerate(every)]
    return sums.select(F.explode(F.array(*lines)).alias("x")).select("x.*")
