"""Assembly of findings of all detectors, and their statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import KEYWORDS, SCANNING
from ..functions.text import seconds
from ..params import DEFAULT, DetectorParams
from . import detect, keyword, summary
from .registry import detectors as registered
from .registry import entry_detectors as registered_entries
from .summary import Store, same
from .windows import distinct_in_seconds, islands, totals_of_seconds

COMMON = ["detector", "finding_type", "pattern_type", "ip", "country", "window", "risk_score", "description", "ref_file", "ref_line", "ref_ts", "request_line", "status", "user_agent", "referer", "bytes_sent", "details"]
_KNOWN = {"ip", "finding_type", "pattern_type", "risk_score", "description", "ref", "country", "window"}


def _common(df: DataFrame, detector: str) -> DataFrame:
    extra = [c for c in df.columns if c not in _KNOWN]
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(
        F.lit(detector).alias("detector"), "finding_type", "pattern_type", "ip", text("country").alias("country"), text("window").alias("window"), "risk_score", "description",
        F.col("ref.file_path").alias("ref_file"), F.col("ref.line_number").alias("ref_line"), F.col("ref.ts").alias("ref_ts"), "ref.request_line", "ref.status", "ref.user_agent", "ref.referer", "ref.bytes_sent",
        (F.to_json(F.struct(*extra)) if extra else F.lit("{}")).alias("details"),
    )


def all_findings(entries: DataFrame, p: DetectorParams = DEFAULT, detectors=("scanning", "behavioral", "geographic"), reputation: DataFrame | None = None, store: Store = same, tried: DataFrame | None = None) -> DataFrame:
    """The findings of the keyword and frequency detectors and of those switched on, in one schema.

    The geographic detector needs reputation rows (a country is known before detection); registered detectors join in.
    All detectors share one pass over the narrow columns of entries (summary.py) and one over their texts; a finding's
    own entry is looked up at the end, by its place, in one join for all findings. `store` writes the shared parts.
    Entries that a detector cannot judge (failures) give no findings of it. tried: by_entry(entries), if at hand.
    """
    tried = by_entry(entries, store) if tried is None else tried
    usable = entries.where(NEEDED["frequency"])
    texts, placed = together(lambda: store("texts", _texts(entries.where(NEEDED["keyword"]), "scanning" in detectors)), lambda: store("placed", _counted(usable, p, detectors, reputation, store)))
    at = ["ref_file", "ref_line"]
    refs = entries.select(F.col("file_path").alias("ref_file"), F.col("line_number").alias("ref_line"), F.col("ts").alias("ref_ts"), "request_line", "status", "user_agent", "referer", "bytes_sent")
    shown = store("shown", refs.join(placed.select(*at).distinct(), at, "left_semi"))
    out = [_common(_keywords(texts), "keyword"), placed.join(shown, at, "left").select(*COMMON)]
    if "scanning" in detectors:
        out.append(_common(detect.signatures_of(texts.where("size(found) > 0").select("ip", *detect.REF, "found")), "scanning"))
    if tried is not None:
        out.append(_tried_findings(tried))
    return _union(out + [_common(f(entries, p), name) for name, f in registered().items()])


#: What the detectors of a group cannot do without.
NEEDED = {"keyword": "is_valid_utf8(concat_ws('', request_line, user_agent, referer))", **dict.fromkeys(("frequency", "scanning", "behavioral", "geographic"), "ip IS NOT NULL AND ts IS NOT NULL")}
_FOUND = "array<struct<finding_type: string, pattern_type: string, risk_score: int, description: string, details: string>>"


def by_entry(entries: DataFrame, store: Store = same) -> DataFrame | None:
    """detector, ip, the entry, found and error: every registered entry detector on every entry, an exception held as
    the error of its row. None if there is no such detector."""
    found = [_by_one(entries, name, fn) for name, fn in registered_entries().items()]
    return store("by_entry", _union(found)) if found else None


def _by_one(entries: DataFrame, name: str, fn: Callable) -> DataFrame:
    rows = entries.select("ip", *detect.REF)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"found {_FOUND}, error string").fields])
    known = ("finding_type", "pattern_type", "risk_score", "description")

    def judge(entry: dict) -> tuple[list, str | None]:
        try:
            return [{**{k: f[k] for k in known}, "details": json.dumps({k: v for k, v in f.items() if k not in known}, separators=(",", ":"))} for f in fn(entry)], None
        except Exception as e:  # a user's detector may fail in any way: the row keeps it
            return [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([*((k, pa.int32() if k == "risk_score" else pa.string()) for k in known), ("details", pa.string())]))
        for batch in batches:
            results = [judge(entry) for entry in batch.to_pylist()]
            columns = [*batch.columns, pa.array([r[0] for r in results], kind), pa.array([r[1] for r in results], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "found", "error"])

    return rows.mapInArrow(run, schema).select(F.lit(name).alias("detector"), "*")


def _tried_findings(tried: DataFrame) -> DataFrame:
    rows = tried.withColumn("x", F.explode("found"))
    none = F.lit(None).cast("string")
    return rows.select("detector", "x.finding_type", "x.pattern_type", "ip", none.alias("country"), none.alias("window"), "x.risk_score", "x.description", F.col("file_path").alias("ref_file"), F.col("line_number").alias("ref_line"), F.col("ts").alias("ref_ts"), "request_line", "status", "user_agent", "referer", "bytes_sent", "x.details")


def failures(entries: DataFrame, tried: DataFrame | None = None, detectors=tuple(NEEDED)) -> DataFrame:
    """detector, ref_file, ref_line, error: the entries that a detector could not judge, built in or registered."""
    lacking = F.filter(F.array(*(F.when(~F.expr(NEEDED[d]), F.lit(d)) for d in detectors)), lambda d: d.isNotNull())
    place = [F.col("file_path").alias("ref_file"), F.col("line_number").alias("ref_line")]
    out = entries.select(*place, F.explode(lacking).alias("detector")).select("detector", "ref_file", "ref_line", F.lit("entry lacks what the detector needs").alias("error"))
    return out if tried is None else out.unionByName(tried.where("error IS NOT NULL").select("detector", *place, "error"))


def together(*builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """Independent parts, written two at a time: each is small, so one alone leaves most cores idle."""
    with ThreadPoolExecutor(2) as pool:
        return [done.result() for done in [pool.submit(build) for build in builds]]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _texts(entries: DataFrame, signatures: bool) -> DataFrame:
    """The entries with a keyword or signature in their texts, and what was found: the only look at all texts."""
    found = detect.signatures_in() if signatures else F.array().cast("array<struct<pattern: string, score: int>>")
    near = keyword.candidates(entries, [p for g in KEYWORDS.values() for p, _ in g] + [q for q, _ in SCANNING if signatures])
    return near.select("ip", *detect.REF, keyword.hits_in().alias("hits"), F.coalesce(found, F.array()).alias("found")).where("size(hits) > 0 OR size(found) > 0")


def _keywords(texts: DataFrame) -> DataFrame:
    rows = keyword.findings_of(texts.where("size(hits) > 0"))
    return rows.withColumn("ref", F.struct(*detect.REF)).select("ip", "finding_type", "pattern_type", "risk_score", "description", "ref", "field", "pattern", "matched_text", "decoded_text", "original_text")


def _late(df: DataFrame, detector: str) -> DataFrame:
    """_common without the entry itself, of which df's ref has the place only."""
    none = {"ts": "timestamp_ntz", "request_line": "string", "status": "int", "user_agent": "string", "referer": "string", "bytes_sent": "long"}
    ref = F.struct("ref.file_path", "ref.line_number", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    return _common(df.withColumn("ref", ref), detector).drop("ref_ts", *(c for c in none if c != "ts"))


def _counted(entries: DataFrame, p: DetectorParams, detectors, reputation: DataFrame | None, store: Store) -> DataFrame:
    """The findings, with the place of their entry, of the detectors that count: all from the shared sums."""
    sums = store("sums", summary.grouped(entries, p))
    times = summary.part(sums, "times")
    builds = [lambda: _of_windows(times, p, store, "behavioral" in detectors)]
    builds.append(lambda: _of_addresses(times, entries, p, store, detectors))
    if "scanning" in detectors:
        builds.append(lambda: _of_paths(times, summary.part(sums, "paths"), entries, p, store))
    if "behavioral" in detectors:
        builds.append(lambda: _of_agents(times, summary.part(sums, "agents"), p, store))
    if "geographic" in detectors and reputation is not None:
        builds.append(lambda: _of_countries(times, reputation, p, store))
    return _union(together(*builds))


def _ref(c: str) -> Column:
    return F.col(c).alias("ref")


def _last_of(times: DataFrame, line: str = "line") -> DataFrame:
    """The place of each address's last entry in time order."""
    has = F.col(line).isNotNull()
    return times.groupBy("ip").agg(F.max_by(F.when(has, summary.place(line)), F.when(has, F.struct("ts", summary.place(line)))).alias("ref"))


def _of_addresses(times: DataFrame, entries: DataFrame, p: DetectorParams, store: Store, detectors) -> DataFrame:
    """What totals of an address show."""
    who = store("addresses", summary.addresses(times))
    out = [("frequency", detect.failed_logins_of(who.select("ip", F.col("failed").alias("failed_logins"), _ref("last_failed")).where("ref IS NOT NULL"), p))]
    out.append(("frequency", detect.frequency_of(who.select("ip", F.col("total").alias("requests"), _ref("last_in")), p)))
    if "scanning" in detectors:
        out.append(("scanning", detect.vulnerability_of(who.select("ip", "total", "not_found", "forbidden", _ref("last_at")), entries, p)))
    if "behavioral" in detectors:
        sizes = detect.sizes_of(who.select("ip", "total", "tiny", "huge", (F.col("size") / F.col("total")).alias("avg_size"), "max_size", _ref("last_at")), p)
        out += [("behavioral", detect.tiny_of(sizes)), ("behavioral", detect.huge_of(sizes, p))]
    return store("of_addresses", _union([_late(f, group) for group, f in out]))


def _of_windows(times: DataFrame, p: DetectorParams, store: Store, behavioral: bool) -> DataFrame:
    """What windows of any length show: the windows of all detectors in one running sum over seconds."""
    spark = times.sparkSession
    secs = store("seconds", summary.in_whole_seconds(times))
    lengths = sorted({v[0] for v in p.windows.values()} | set(p.dos_windows.values()))
    least = min([v[1] for v in p.windows.values()] + [v[2] for v in p.windows.values()] + [p.dos_burst_threshold])
    busy = secs.join(secs.groupBy("ip").agg(F.sum("n").alias("total")).where(F.col("total") >= least).select("ip"), "ip", "left_semi")
    totals = totals_of_seconds(busy, {str(w): w for w in lengths})
    peaks = totals.groupBy("ip", "window").agg(F.max("requests").alias("max_requests"), F.max("flagged").alias("max_failed"), F.sum(detect.burst_starts(p)).alias("starts"))
    last = summary.place("line")
    ends = times.groupBy("ip").agg(F.max(last).alias("last_in"), F.max(F.when(F.col("failed_line").isNotNull(), summary.place("failed_line"))).alias("last_failed"), F.max_by(last, F.struct("ts", last)).alias("last_at"))
    peaks = store("peaks", peaks.join(ends, "ip"))
    names = spark.createDataFrame([(str(v[0]), k, "frequency") for k, v in p.windows.items()] + [(str(w), k, "dos") for k, w in p.dos_windows.items()], "window string, name string, kind string")
    named = peaks.join(F.broadcast(names), "window").drop("window").withColumnRenamed("name", "window")
    windowed, dos = named.where("kind = 'frequency'"), named.where("kind = 'dos'")
    out = [("frequency", detect.brute_force_of(windowed.where("last_failed IS NOT NULL").withColumn("ref", F.col("last_failed")), p)), ("frequency", detect.bursts_of(windowed.withColumn("ref", F.col("last_in")), p))]
    if behavioral:
        at = peaks.select("ip", _ref("last_at")).distinct()
        out.append(("behavioral", detect.dos_bursts_of(dos.withColumnRenamed("max_requests", "m").select("ip", "window", "m", "starts"), at, p)))
        out.append(("behavioral", detect.sessions_of(secs.select("ip", "sec", "n"), _last_of(times), p)))
    return store("of_windows", _union([_late(f, group) for group, f in out]))


def _of_paths(times: DataFrame, steps: DataFrame, entries: DataFrame, p: DetectorParams, store: Store) -> DataFrame:
    paths = steps.groupBy("ip", "path").agg(F.sum("n").alias("n"))
    many = store("many_paths", detect.many_paths_of(paths, p).join(detect.first_items(paths, "path", "sample_paths", 20), "ip"))
    hot = steps.join(many.select("ip"), "ip", "left_semi").select("ip", "path", seconds(F.col("ts")).alias("sec"), "n")
    items = hot.where("path IS NOT NULL").select("ip", "path", "sec").distinct()
    periods = detect.path_periods(hot.groupBy("ip", "sec").agg(F.sum("n").alias("n")), items, entries, p, store)
    return store("of_paths", _late(detect.path_enumeration_of(periods.join(many, "ip").join(_last_of(times), "ip")), "scanning"))


def _of_agents(times: DataFrame, agents: DataFrame, p: DetectorParams, store: Store) -> DataFrame:
    agents = agents.where("agent IS NOT NULL").select("ip", F.col("agent").alias("user_agent"))
    seen = times.where("agent_line IS NOT NULL").groupBy("ip").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max_by(summary.place("agent_line"), F.struct("ts", summary.place("agent_line"))).alias("ref"))
    g = agents.groupBy("ip").agg(F.count("*").alias("agents")).where(F.col("agents") >= p.ua_rotation_threshold).join(seen, "ip")
    return store("of_agents", _late(detect.rotation_of(g, agents, p), "behavioral"))


def _of_countries(times: DataFrame, reputation: DataFrame, p: DetectorParams, store: Store) -> DataFrame:
    """A country holds for an address and time, so the sums by time are all that these detectors need."""
    geo = store("geo_times", times.join(detect.countries_at(times.select("ip", "ts").distinct(), reputation), ["ip", "ts"]).withColumn("sec", seconds(F.col("ts"))))
    last = F.max_by(summary.place("line"), F.struct("ts", summary.place("line"))).alias("ref")
    kinds = store("geo_countries", geo.groupBy("ip", "country").agg(F.sum("n").alias("total"), F.sum("failed").alias("failed"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), last))
    many = kinds.groupBy("ip").agg(F.count("*").alias("c"), F.max_by("ref", F.struct("t1", "ref")).alias("ref")).where(F.col("c") >= p.geo_change_threshold)
    hot = geo.join(many.select("ip"), "ip", "left_semi")
    each = hot.groupBy("ip", "sec").agg(F.sum("n").alias("n"))
    spans = store("geo_spans", islands(hot.select("ip", "country", "sec").distinct(), p.geo_window, "country"))
    held = each.join(distinct_in_seconds(each, spans, p.geo_window), ["ip", "sec"]).where(F.col("n_distinct") >= p.geo_change_threshold)
    changed = held.groupBy("ip").agg(F.max("n_distinct").alias("max_countries"), F.sum("n").alias("periods"))
    travel = detect.quick_changes(geo.select("ip", "country", "ts", "file_path", F.col("first_line").alias("line_number")), p)
    out = [detect.high_risk_of(kinds, p), detect.rapid_changes_of(changed.join(many.select("ip", "ref"), "ip"), p), detect.travel_of(travel.withColumn("ref", F.struct("at.file_path", "at.line_number")))]
    return store("of_countries", _union([_late(f, "geographic") for f in out]))


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Highest risk first, then fixed keys."""
    return findings.orderBy(F.desc("risk_score"), "detector", "pattern_type", "ip", "ref_line", "window", "finding_type", "details")


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    r = F.col("risk_score")
    return findings.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(r.between(80, 100)).alias("high"), F.count_if(r.between(50, 79)).alias("medium"), F.count_if(r.between(20, 49)).alias("low"), F.count_if(r.between(1, 19)).alias("info"))


def detector_statistics(findings: DataFrame, entries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per detector: findings by severity, entries, entries that failed (failures, several of one entry are one) and the
    share of the others in per cent, 0 without entries. A detector that only failed is there too."""
    failed = failures(entries) if failed is None else failed
    n = entries.agg(F.count("*").alias("entries_processed"))
    bad = failed.groupBy("detector", "ref_file", "ref_line").agg(F.lit(1).alias("one")).groupBy("detector").agg(F.count("*").alias("processing_errors"))
    both = severity_counts(findings, "detector").join(bad, "detector", "full").crossJoin(F.broadcast(n)).na.fill(0)
    good = (F.col("entries_processed") - F.col("processing_errors")) * 100.0
    return both.withColumn("success_rate", F.when(F.col("entries_processed") > 0, good / F.col("entries_processed")).otherwise(0.0))


def pattern_type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pattern_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern_type")
