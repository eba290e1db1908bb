"""Detectors that group entries by client address. Each returns one row per finding with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import fold, matches
from ..functions.patterns import SCANNING
from ..functions.text import seconds
from ..params import DEFAULT, DetectorParams
from .keyword import candidates
from .summary import Store, same
from .windows import SPAN, distinct_in_seconds, in_seconds, islands, positioned, second_totals, window_counts, window_distinct, window_items, window_peaks

REF = ("file_path", "line_number", "ts", "request_line", "status", "user_agent", "referer", "bytes_sent")
INPUT = ("file_path", "line_number")  # input order
TIME = ("ts", "file_path", "line_number")  # time order
FAILED = "status IN (401, 403)"


def _last(order, when: str | None = None) -> Column:
    """The entry that is last in an order, among those for which `when` holds."""
    ref = F.struct(*REF)
    by = F.struct(*order)
    return (F.max_by(ref, by) if when is None else F.max_by(F.when(F.expr(when), ref), F.when(F.expr(when), by))).alias("ref")


def _mapping(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _int(c: Column) -> Column:
    return c.cast("int")


def _finding(df: DataFrame, finding_type, pattern_type: str, risk: Column, description: Column, *keep: str) -> DataFrame:
    kind = F.lit(finding_type) if isinstance(finding_type, str) else finding_type
    return df.select("ip", kind.alias("finding_type"), F.lit(pattern_type).alias("pattern_type"), _int(risk).alias("risk_score"), description.alias("description"), "ref", *keep)


def _seconds_of(entries: DataFrame) -> DataFrame:
    """What windows over whole seconds need of entries."""
    return entries.select("ip", seconds(F.col("ts")).alias("sec"), F.when(F.expr(FAILED), 1).otherwise(0).alias("failed"))


# -- frequency -----------------------------------------------------------------------------------------


def ip_status_distribution(entries: DataFrame) -> DataFrame:
    """Per address a map of status to count."""
    return entries.groupBy("ip", "status").agg(F.count("*").alias("n")).groupBy("ip").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"), F.sum("n").alias("total"))


def failed_login_pattern(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    return failed_logins_of(entries.where(FAILED).groupBy("ip").agg(F.count("*").alias("failed_logins"), _last(INPUT)), p)


def failed_logins_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    n = F.col("failed_logins")
    return _finding(g.where(n >= p.failed_login_threshold), "Failed Login Pattern", "failed_login_frequency", F.least(70 + (n - 5) * 5, F.lit(100)), F.concat(F.lit("Detected "), n, F.lit(" failed login attempts from IP "), "ip"), "failed_logins")


def high_request_frequency(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    return frequency_of(entries.groupBy("ip").agg(F.count("*").alias("requests"), _last(INPUT)), p)


def frequency_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    n = F.col("requests")
    return _finding(g.where(n >= p.high_frequency_threshold), "High Request Frequency", "high_frequency_requests", F.least(50 + (n - 50), F.lit(85)), F.concat(F.lit("Detected "), n, F.lit(" requests from IP "), "ip"), "requests")


def sliding_window_stats(entries: DataFrame, windows: dict | None = None, p: DetectorParams = DEFAULT) -> DataFrame:
    """Per address and window: most requests and failed logins; per address: totals, distinct paths and agents."""
    windows = windows or {k: v[0] for k, v in p.windows.items()}
    peaks = window_peaks(_seconds_of(entries), windows).withColumnRenamed("max_flagged", "max_failed")
    totals = entries.groupBy("ip").agg(F.count("*").alias("total"), F.count_distinct("path").alias("paths"), F.count_distinct(F.when(F.col("user_agent") != "", F.col("user_agent"))).alias("agents"))
    return peaks.join(totals, "ip")


def burst_periods(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """Every row from which a short window holds many requests."""
    busy = entries.groupBy("ip").agg(F.count("*").alias("n")).where(F.col("n") >= p.burst_period_requests).select("ip")
    rows = positioned(entries.join(busy, "ip", "left_semi"))
    return window_counts(rows, {"1min": p.burst_period_window}).where(F.col("requests") >= p.burst_period_requests).select("ip", "window", "sec", "pos", "requests")


def _window_refs(entries: DataFrame, found: DataFrame, when: str | None) -> DataFrame:
    refs = entries.groupBy("ip").agg(_last(INPUT, when))
    return found.join(refs, "ip")


def time_windowed_brute_force(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    hot = entries.where(FAILED).groupBy("ip").agg(F.count("*").alias("n")).where(F.col("n") >= min(v[1] for v in p.windows.values())).select("ip")
    rows = _seconds_of(entries.join(hot, "ip", "left_semi"))
    peaks = window_peaks(rows, {k: v[0] for k, v in p.windows.items()}).select("ip", "window", F.col("max_flagged").alias("max_failed"))
    return brute_force_of(_window_refs(entries, peaks, FAILED), p)


def brute_force_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    m = F.col("max_failed")
    got = g.where(m >= _mapping({k: v[1] for k, v in p.windows.items()})[F.col("window")])
    return _finding(got, F.concat(F.lit("Time-Windowed Brute Force ("), "window", F.lit(")")), "time_windowed_brute_force", F.least(85 + m * 2, F.lit(100)), F.concat(F.lit("Detected "), m, F.lit(" failed logins within "), "window", F.lit(" from IP "), "ip"), "window", "max_failed")


def request_burst_pattern(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    hot = entries.groupBy("ip").agg(F.count("*").alias("n")).where(F.col("n") >= min(v[2] for v in p.windows.values())).select("ip")
    rows = _seconds_of(entries.join(hot, "ip", "left_semi"))
    peaks = window_peaks(rows, {k: v[0] for k, v in p.windows.items()}).select("ip", "window", "max_requests")
    return bursts_of(_window_refs(entries, peaks, None), p)


def bursts_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    m = F.col("max_requests")
    got = g.withColumn("least", _mapping({k: v[2] for k, v in p.windows.items()})[F.col("window")]).where("max_requests >= least")
    return _finding(got, F.concat(F.lit("Request Burst Pattern ("), "window", F.lit(")")), "time_windowed_burst", F.least(75 + F.floor((m - F.col("least")) / 10), F.lit(95)), F.concat(F.lit("Detected "), m, F.lit(" requests within "), "window", F.lit(" from IP "), "ip"), "window", "max_requests")


# -- scanning ------------------------------------------------------------------------------------------


def _many_paths(entries: DataFrame, p: DetectorParams) -> DataFrame:
    """Addresses that can have such a window at all."""
    return entries.groupBy("ip").agg(F.count_distinct("path").alias("d"), F.count("*").alias("n")).where((F.col("d") >= p.unique_paths_threshold) & (F.col("n") >= 10)).select("ip")


def scan_periods(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """Windows from every row with many distinct paths; sample_paths: the distinct ones of its first 20 requests."""
    rows = positioned(entries.join(_many_paths(entries, p), "ip", "left_semi"))
    distinct = window_distinct(rows, p.scan_window, "path").where(F.col("n_distinct") >= p.unique_paths_threshold)
    counts = window_counts(rows.withColumn("has", F.col("path").isNotNull().cast("int")), {"scan": p.scan_window}, "has")
    found = distinct.join(counts.select("ip", "pos", F.col("flagged").alias("total_requests")), ["ip", "pos"]).select("ip", "sec", "pos", F.col("n_distinct").alias("unique_paths"), "total_requests")
    return found.join(_first_paths(found, rows, p.scan_window), ["ip", "pos"])


def _first_paths(found: DataFrame, rows: DataFrame, w: int, k: int = 20) -> DataFrame:
    """ip, pos, sample_paths of found periods: the rows at the next k positions, dealt out by blocks of positions."""
    block = lambda c: F.floor(F.col(c) / 1000)
    near = rows.where("path IS NOT NULL").select("ip", F.col("pos").alias("q"), F.col("sec").alias("t"), "path").withColumn("block", F.explode(F.array_distinct(F.array(block("q"), F.floor((F.col("q") - (k - 1)) / 1000)))))
    met = found.select("ip", "pos", "sec").withColumn("block", block("pos")).join(near, ["ip", "block"]).where((F.col("q") >= F.col("pos")) & (F.col("q") < F.col("pos") + k) & (F.col("t") <= F.col("sec") + w))
    return met.groupBy("ip", "pos").agg(F.array_sort(F.collect_set("path")).alias("sample_paths"))


def path_enumeration(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    at = seconds(F.col("ts")).alias("sec")
    paths = entries.groupBy("ip", "path").agg(F.count("*").alias("n"))
    many = many_paths_of(paths, p)
    hot = entries.join(many.select("ip"), "ip", "left_semi")
    secs = hot.groupBy("ip", at).agg(F.count("*").alias("n"))
    items = hot.where("path IS NOT NULL").select("ip", "path", at).distinct()
    periods = path_periods(secs, items, entries, p)
    g = periods.join(many, "ip").join(first_items(paths, "path", "sample_paths", 20), "ip").join(entries.groupBy("ip").agg(_last(TIME)), "ip")
    return path_enumeration_of(g)


def many_paths_of(paths: DataFrame, p: DetectorParams) -> DataFrame:
    """Addresses that can have such a window at all, from their distinct paths with counts."""
    return paths.groupBy("ip").agg(F.count("path").alias("total_paths"), F.sum("n").alias("n")).where((F.col("total_paths") >= p.unique_paths_threshold) & (F.col("n") >= 10)).drop("n")


def first_items(counts: DataFrame, item: str, name: str, k: int) -> DataFrame:
    """The first k items of each address; only these are ordered."""
    ranked = counts.where(F.col(item).isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("ip").orderBy(item))).where(F.col("k") <= k)
    return ranked.groupBy("ip").agg(F.sort_array(F.collect_list(item)).alias(name))


def path_periods(secs: DataFrame, items: DataFrame, entries: DataFrame, p: DetectorParams, store: Store = same) -> DataFrame:
    """Per address the most distinct paths of a window from one of its rows, and the rows from which there are enough.

    All from seconds: the first row of a second sees all paths of the window, and its later rows lose only paths whose
    last time in the window is an earlier row of that second. So all n rows of a second have enough where those paths
    are not needed, none where even the first has not; rows are looked at for the seconds between. secs: ip, sec, n;
    items: distinct ip, path, sec.
    """
    w, least = p.scan_window, p.unique_paths_threshold
    spans = store("path_spans", islands(items, w, "path"))
    found = secs.join(distinct_in_seconds(secs, spans, w), ["ip", "sec"]).where(F.col("n_distinct") >= least)
    found = store("path_seconds", found.withColumn("need", least - F.col("n_distinct") + F.coalesce("n_last", F.lit(0))))
    between = found.where("need > 0").select("ip", "sec", "need")
    rows = in_seconds(entries.withColumn("sec", seconds(F.col("ts"))).join(between.select("ip", "sec"), ["ip", "sec"], "left_semi"))
    last = spans.select("ip", "path", F.col("last.sec").alias("sec"))
    ends = rows.groupBy("ip", "sec", "path").agg(F.max("pos").alias("pos")).join(last, ["ip", "sec", "path"], "left_semi")
    ranked = ends.withColumn("k", F.row_number().over(Window.partitionBy("ip", "sec").orderBy(F.desc("pos")))).where(F.col("k") <= least)
    cut = ranked.join(between, ["ip", "sec"]).where("k = need").select("ip", "sec", F.col("pos").cast("long").alias("cut"))
    each = found.join(cut, ["ip", "sec"], "left").withColumn("starts", F.when(F.col("need") > 0, F.col("cut")).otherwise(F.col("n")))
    return each.groupBy("ip").agg(F.max("n_distinct").alias("max_paths"), F.sum("starts").alias("periods"))


def path_enumeration_of(g: DataFrame) -> DataFrame:
    m = F.col("max_paths")
    return _finding(g, "Path Enumeration Scan", "path_enumeration", F.least(60 + m * 2, F.lit(90)), F.concat(F.lit("Detected scanning of "), m, F.lit(" unique paths from IP "), "ip"), "max_paths", "periods", "total_paths", "sample_paths")


def scanning_tool_signature(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    near = candidates(entries, [q for q, _ in SCANNING])
    return signatures_of(near.withColumn("found", signatures_in()).where("size(found) > 0"))


def signatures_in() -> Column:
    """Signatures in the raw agent, request and referer; a pattern is run only where its literals are."""
    fields = F.transform(F.filter(F.array("user_agent", "request_line", "referer"), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("text"), fold(x).alias("folded")))
    of = lambda x: F.filter(F.array(*(F.when(matches(x["text"], x["folded"], q), F.struct(F.lit(q).alias("pattern"), F.lit(s).alias("score"))) for q, s in SCANNING)), lambda y: y.isNotNull())
    return F.array_distinct(F.flatten(F.transform(fields, of)))


def signatures_of(rows: DataFrame) -> DataFrame:
    g = rows.withColumn("x", F.explode("found")).groupBy("ip").agg(F.sort_array(F.collect_set("x.pattern")).alias("patterns"), F.sort_array(F.collect_set("x")).alias("scores"), F.count("*").alias("matches"), F.max("x.score").alias("max_score"), _last(TIME))
    return _finding(g, "Scanning Tool Signature", "scanning_tool_signature", F.least(F.col("max_score") + 10, F.lit(95)), F.concat(F.lit("Detected scanning tool signatures from IP "), "ip", F.lit(": "), F.array_join(F.slice("patterns", 1, 3), ", ")), "patterns", "scores", "matches", "max_score")


def vulnerability_scanning(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    g = entries.groupBy("ip").agg(F.count("*").alias("total"), F.count_if(F.col("status") == 404).alias("not_found"), F.count_if(F.col("status") == 403).alias("forbidden"), _last(TIME))
    return vulnerability_of(g, entries, p)


def vulnerability_of(g: DataFrame, entries: DataFrame, p: DetectorParams) -> DataFrame:
    g = g.withColumns({"not_found_ratio": F.col("not_found") / F.col("total"), "forbidden_ratio": F.col("forbidden") / F.col("total")}).where((F.col("total") >= p.vuln_min_requests) & (F.col("not_found_ratio") >= p.vuln_ratio))
    missing = entries.join(g.select("ip"), "ip", "left_semi").where("status = 404 AND path IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("ip").orderBy(*TIME))).where("k <= 10")
    g = g.join(missing.groupBy("ip").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("sample_paths")), "ip", "left")
    r = F.col("not_found_ratio")
    return _finding(g, "Vulnerability Scanning Pattern", "vulnerability_scanning", F.least(65 + _int(r * 20), F.lit(85)), F.concat(F.lit("Detected vulnerability scanning from IP "), "ip", F.format_string(" (%.1f%% 404 responses)", r * 100)), "total", "not_found_ratio", "forbidden_ratio", "sample_paths")


# -- behaviour -----------------------------------------------------------------------------------------


def dos_burst_periods(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """Every row from which one of the windows holds a burst: start, requests and duration."""
    hot = entries.groupBy("ip").agg(F.count("*").alias("n")).where(F.col("n") >= p.dos_burst_threshold).select("ip")
    size = _mapping(p.dos_windows)
    found = window_counts(positioned(entries.join(hot, "ip", "left_semi")), p.dos_windows).where(F.col("requests") >= p.dos_burst_threshold)
    return found.select("ip", "window", "sec", "pos", "requests", size[F.col("window")].alias("duration"))


def dos_burst_pattern(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """The smallest window that reaches the largest number of requests; burst_periods: rows that begin a burst of any
    window (dos_burst_periods has them), from the counts of seconds: a second of n rows and a window of m have
    min(n, m - threshold + 1) of them."""
    hot = entries.groupBy("ip").agg(F.count("*").alias("n")).where(F.col("n") >= p.dos_burst_threshold).select("ip")
    rows = _seconds_of(entries.join(hot, "ip", "left_semi"))
    own = rows.groupBy("ip", "sec").agg(F.count("*").alias("n"))
    peaks = second_totals(rows, p.dos_windows).join(own, ["ip", "sec"]).groupBy("ip", "window").agg(F.max("requests").alias("m"), F.sum(burst_starts(p)).alias("starts"))
    return dos_bursts_of(peaks, entries.groupBy("ip").agg(_last(TIME)), p)


def burst_starts(p: DetectorParams) -> Column:
    return F.greatest(F.least("n", F.col("requests") - p.dos_burst_threshold + 1), F.lit(0))


def dos_bursts_of(peaks: DataFrame, refs: DataFrame, p: DetectorParams) -> DataFrame:
    size = _mapping(p.dos_windows)
    g = peaks.groupBy("ip").agg(F.max("m").alias("max_burst"), F.max_by("window", F.struct("m", -size[F.col("window")])).alias("window"), F.sum("starts").alias("burst_periods")).where(F.col("max_burst") >= p.dos_burst_threshold)
    m = F.col("max_burst")
    return _finding(g.join(refs, "ip"), F.concat(F.lit("DoS Burst Pattern ("), "window", F.lit(")")), "dos_burst_pattern", F.least(80 + F.floor((m - p.dos_burst_threshold) / 10), F.lit(100)), F.concat(F.lit("Detected "), m, F.lit(" requests in "), "window", F.lit(" from IP "), "ip"), "window", "max_burst", "burst_periods")


def user_agent_rotation(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    rows = entries.where("user_agent <> ''")
    g = rows.groupBy("ip").agg(F.count_distinct("user_agent").alias("agents"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), _last(TIME))
    return rotation_of(g, rows.select("ip", "user_agent").distinct(), p)


def rotation_of(g: DataFrame, agents: DataFrame, p: DetectorParams) -> DataFrame:
    g = g.where(F.col("agents") >= p.ua_rotation_threshold)
    minutes = (seconds(F.col("t1")) - seconds(F.col("t0"))) / 60.0
    g = g.withColumn("per_minute", F.col("agents") / F.greatest(minutes, F.lit(1.0)))
    n = F.col("agents")
    return _finding(g.join(first_items(agents, "user_agent", "sample_agents", 10), "ip"), "User Agent Rotation", "user_agent_rotation", F.least(65 + n * 3, F.lit(90)), F.concat(F.lit("Detected "), n, F.lit(" different user agents from IP "), "ip"), "agents", "per_minute", "sample_agents")


def _sizes(entries: DataFrame, p: DetectorParams) -> DataFrame:
    size = F.octet_length("request_line")
    g = entries.groupBy("ip").agg(F.count("*").alias("total"), F.count_if(size < p.tiny_bytes).alias("tiny"), F.count_if(size > p.huge_bytes).alias("huge"), F.avg(size).alias("avg_size"), F.max(size).alias("max_size"), _last(TIME))
    return sizes_of(g, p)


def sizes_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    g = g.where(F.col("total") >= p.size_min_entries).withColumns({"tiny_ratio": F.col("tiny") / F.col("total"), "huge_ratio": F.col("huge") / F.col("total")})
    return g.withColumn("is_tiny", (F.col("tiny_ratio") > p.tiny_ratio) & (F.col("tiny") > p.tiny_count))


def automated_request_pattern(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    return tiny_of(_sizes(entries, p))


def tiny_of(sizes: DataFrame) -> DataFrame:
    r = F.col("tiny_ratio")
    return _finding(sizes.where("is_tiny"), "Automated Request Pattern", "automated_request_pattern", F.least(60 + _int(r * 30), F.lit(85)), F.concat(F.format_string("Detected %.1f%% tiny requests from IP ", r * 100), "ip", F.lit(" (possible automation)")), "tiny", "tiny_ratio", "avg_size")


def large_request_pattern(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    return huge_of(_sizes(entries, p), p)


def huge_of(sizes: DataFrame, p: DetectorParams) -> DataFrame:
    r = F.col("huge_ratio")
    got = sizes.where(~F.col("is_tiny") & (r > p.huge_ratio) & (F.col("huge") > p.huge_count))
    return _finding(got, "Large Request Pattern", "large_request_pattern", F.least(70 + _int(r * 40), F.lit(95)), F.concat(F.format_string("Detected %.1f%% large requests from IP ", r * 100), "ip", F.lit(" (possible data exfiltration)")), "huge", "huge_ratio", "max_size")


def automated_session_pattern(entries: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """One whole-second gap below a minute and no other such gap, often enough."""
    return sessions_of(entries.groupBy("ip", seconds(F.col("ts")).alias("sec")).agg(F.count("*").alias("n")), entries.groupBy("ip").agg(_last(TIME)), p)


def sessions_of(secs: DataFrame, refs: DataFrame, p: DetectorParams) -> DataFrame:
    # rows of one second lie 0 seconds apart: a second of n rows has n - 1 such gaps beside that to the second before
    order = Window.partitionBy("ip").orderBy("sec")
    secs = secs.withColumns({"gap": F.col("sec") - F.lag("sec").over(order), "k": F.row_number().over(order)})
    short = F.array_compact(F.array(F.when(F.col("gap") < p.session_max_gap, F.col("gap")), F.when((F.col("n") > 1) & F.lit(p.session_max_gap > 0), F.lit(0).cast("long"))))
    own = F.concat(F.array_compact(F.array("gap")), F.array_repeat(F.lit(0).cast("long"), F.least(F.col("n") - 1, F.lit(10)).cast("int")))
    g = secs.withColumn("gap1", F.array_min(short)).withColumn("gap2", F.array_max(short)).groupBy("ip").agg(
        F.sum("n").alias("entries"), (F.sum("n") - 1).alias("gaps"), F.min("gap1").alias("low"), F.max("gap2").alias("high"), F.try_divide(F.max("sec") - F.min("sec"), F.sum("n") - 1).alias("avg_gap"),
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= 11, F.struct("k", own.alias("own"))))), lambda x: x["own"])), 1, 10).alias("first_gaps"),
    )
    g = g.withColumn("kinds", F.when(F.col("low") == F.col("high"), 1).otherwise(2)).where("low IS NOT NULL").join(refs, "ip")
    g = g.where((F.col("entries") >= p.session_min_entries) & (F.col("kinds") == 1) & (F.col("gaps") >= p.session_min_gaps))
    return _finding(g, "Automated Session Pattern", "automated_session_pattern", F.least(70 + F.col("gaps"), F.lit(90)), F.concat(F.lit("Detected machine-like timing pattern from IP "), "ip", F.format_string(" (avg %.1fs intervals)", F.col("avg_gap"))), "gaps", "avg_gap", "first_gaps")


# -- geography -----------------------------------------------------------------------------------------


def countries_at(times: DataFrame, reputation: DataFrame, provider: str = "abuseipdb") -> DataFrame:
    """ip, ts, country of the given distinct times of addresses: the last reputation row at or before; others drop."""
    known = reputation.where(F.col("provider") == provider).select("ip", F.col("query_ts").alias("ts"), F.lit(0).alias("kind"), "country_code")
    asked = times.select("ip", "ts", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("country_code"))
    run = Window.partitionBy("ip").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return known.unionByName(asked).withColumn("country", F.last("country_code", ignorenulls=True).over(run)).where("kind = 1 AND country IS NOT NULL").select("ip", "ts", "country")


def attach_country(entries: DataFrame, reputation: DataFrame, provider: str = "abuseipdb") -> DataFrame:
    """As-of join: the country of the last reputation row of the address at or before the entry; others drop. Only the
    distinct times of an address meet its reputation; entries meet the answer by address and time."""
    found = countries_at(entries.select("ip", "ts").distinct(), reputation, provider)
    return entries.join(found, ["ip", "ts"]).select(*entries.columns, "country")


def geo_change_periods(geo: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """Every row from which a window holds many countries, with these countries."""
    many = geo.groupBy("ip").agg(F.count_distinct("country").alias("c")).where(F.col("c") >= p.geo_change_threshold).select("ip")
    rows = positioned(geo.join(many, "ip", "left_semi"), "country")
    hot = window_distinct(rows, p.geo_window, "country").where(F.col("n_distinct") >= p.geo_change_threshold)
    return window_items(hot, rows, p.geo_window, "country").select("ip", "sec", "pos", F.size("items").alias("count"), F.col("items").alias("countries"))


def rapid_geographic_changes(geo: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    many = geo.groupBy("ip").agg(F.count_distinct("country").alias("c")).where(F.col("c") >= p.geo_change_threshold).select("ip")
    rows = positioned(geo.join(many, "ip", "left_semi"), "country")
    hot = window_distinct(rows, p.geo_window, "country").where(F.col("n_distinct") >= p.geo_change_threshold)
    g = hot.groupBy("ip").agg(F.max("n_distinct").alias("max_countries"), F.count("*").alias("periods")).join(geo.groupBy("ip").agg(_last(TIME)), "ip")
    return rapid_changes_of(g, p)


def rapid_changes_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    m = F.col("max_countries")
    return _finding(g, "Rapid Geographic Changes", "rapid_geographic_changes", F.least(85 + m * 5, F.lit(100)), F.concat(F.lit("Detected "), m, F.lit(f" countries within {p.geo_window // 60} minutes from IP "), "ip"), "max_countries", "periods")


def high_risk_country_activity(geo: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    g = geo.where(F.col("country").isin(*p.country_multipliers)).groupBy("ip", "country").agg(F.count("*").alias("total"), F.count_if(F.expr(FAILED)).alias("failed"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), _last(TIME))
    return high_risk_of(g, p)


def high_risk_of(g: DataFrame, p: DetectorParams) -> DataFrame:
    g = g.withColumn("multiplier", _mapping(p.country_multipliers)[F.col("country")]).where("multiplier IS NOT NULL")
    hours = F.greatest((seconds(F.col("t1")) - seconds(F.col("t0"))) / 3600.0, F.lit(1.0))
    g = g.withColumns({"rate": F.col("total") / hours, "failed_rate": F.col("failed") / hours})
    over = F.col("rate") > p.country_requests_per_hour / F.col("multiplier")
    g = g.withColumn("over", over).where(over | (F.col("failed_rate") > p.country_failed_per_hour / F.col("multiplier")))
    risk = F.least(_int(F.when(F.col("over"), 70).otherwise(65) * F.col("multiplier")), F.lit(95))
    return _finding(g, F.concat(F.lit("High-Risk Country Activity ("), "country", F.lit(")")), "high_risk_country_activity", risk, F.concat(F.lit("Elevated activity from high-risk country "), "country", F.lit(": "), "total", F.lit(" requests, "), "failed", F.lit(" failed logins")), "country", "total", "failed", "rate", "failed_rate")


def impossible_travel(geo: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """Country changes that come too soon after the first row of the previous country's run."""
    g = quick_changes(geo, p)
    # the whole row of the last change only
    refs = geo.select("ip", F.struct(*TIME).alias("at"), F.struct(*REF).alias("ref"))
    return travel_of(g.join(refs, ["ip", "at"]).dropDuplicates(["ip"]))


def quick_changes(rows: DataFrame, p: DetectorParams = DEFAULT) -> DataFrame:
    """ip, changes, countries, at (place of the last change): rows have ip, country and the columns of TIME.

    An address's rows are cut into slices of SPAN seconds. Inside a slice the starts of runs are found, and the changes
    whose previous run began in the slice are judged at once. What is left of a slice is a summary of fixed size: its
    first and second run, the start and country of its last one, and its judged changes added up. Only the summaries of
    an address meet, in order: a slice that begins with the country before it continues that run, so the run's start is
    carried on, and the slice's first changes are judged with it.
    """
    when = F.struct(*TIME)
    sliced = rows.select("ip", "country", *TIME, when.alias("at"), seconds(F.col("ts")).alias("sec")).withColumn("slice", F.floor(F.col("sec") / SPAN))
    inside = Window.partitionBy("ip", "slice").orderBy(*TIME)
    runs = sliced.withColumn("was", F.lag("country").over(inside)).where("was IS NULL OR was <> country")
    runs = runs.withColumns({"k": F.row_number().over(inside), "began": F.lag("sec").over(inside)})
    quick = (F.col("k") > 2) & (F.col("sec") - F.col("began") < p.travel_seconds)
    run = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    s = runs.groupBy("ip", "slice").agg(
        F.max("k").alias("n"), run("country", 1).alias("c1"), run("sec", 1).alias("t1"), run("at", 1).alias("at1"), run("country", 2).alias("c2"), run("sec", 2).alias("t2"), run("at", 2).alias("at2"),
        F.max_by("country", "k").alias("last"), F.max("sec").alias("last_began"), F.count_if(quick).alias("changes"), F.max(F.when(quick, F.col("at"))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set(F.when(quick, F.array("was", "country"))))).alias("countries"),
    )
    order = Window.partitionBy("ip").orderBy("slice")
    s = s.withColumn("before", F.lag("last").over(order))
    goes_on = F.coalesce(F.col("before") == F.col("c1"), F.lit(False))
    known = F.when(F.col("n") > 1, F.col("last_began")).when(~goes_on, F.col("t1"))
    s = s.withColumn("carried", F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.col("before").isNotNull() & ~goes_on & (F.col("t1") - F.col("carried") < p.travel_seconds)
    second = (F.col("n") > 1) & (F.col("t2") - F.when(goes_on, F.col("carried")).otherwise(F.col("t1")) < p.travel_seconds)
    s = s.withColumns({"first": F.coalesce(first, F.lit(False)), "second": F.coalesce(second, F.lit(False))})
    pair = F.concat("countries", F.when(F.col("first"), F.array("before", "c1")).otherwise(F.array().cast("array<string>")), F.when(F.col("second"), F.array("c1", "c2")).otherwise(F.array().cast("array<string>")))
    last = F.greatest(F.col("at"), F.when(F.col("first"), F.col("at1")), F.when(F.col("second"), F.col("at2")))
    g = s.groupBy("ip").agg((F.sum("changes") + F.count_if("first") + F.count_if("second")).alias("changes"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(pair)))).alias("countries"), F.max(last).alias("at"))
    return g.where("changes > 0")


def travel_of(g: DataFrame) -> DataFrame:
    n = F.col("changes")
    return _finding(g, "Impossible Travel Pattern", "impossible_travel", F.least(90 + n * 2, F.lit(100)), F.concat(F.lit("Detected "), n, F.lit(" rapid country changes from IP "), "ip", F.lit(" (impossible travel)")), "changes", "countries")
