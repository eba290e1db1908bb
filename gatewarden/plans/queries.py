"""One query for each operator, over the access log and reputation derived from the given tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import request_path, url_decode_text
from ..operators import detect, enrich, findings, history, keyword, parse, registry, score, traffic
from ..params import DEFAULT
from ..sources import derived, logs, publish
from ..sources.listing import list_files

#: Lower thresholds for detectors that the derived log does not reach with the usual ones.
LOW = replace(DEFAULT, windows={"1min": (60, 2, 10), "5min": (300, 4, 25), "15min": (900, 8, 50), "1hour": (3600, 16, 100)}, dos_burst_threshold=20, vuln_ratio=0.1, tiny_bytes=28, tiny_ratio=0.3, huge_bytes=30, huge_ratio=0.05, country_requests_per_hour=5.0, country_failed_per_hour=2.0, session_min_gaps=2, session_max_gap=2, burst_period_requests=10)
#: With the usual size of a tiny request, so that the rule for large ones gets its turn.
LARGE = replace(LOW, tiny_bytes=DEFAULT.tiny_bytes)


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles to six places, arrays as text: types that any engine shares."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("long") if kind in ("int", "smallint", "bigint") else F.round(c, 6) if kind == "double" else F.array_join(c.cast("array<string>"), "|") if kind.startswith("array") else c).alias(name))
    return df.select(*out)


_stored: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only where it is unset and all tasks run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gatewarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Tables:
    """The tables that the queries share. Each is written once a session and read by all queries after, so that
    lines are parsed once and only the columns a query needs are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, None

    def _state(self) -> tuple:
        """Size and time of the input's files: with another input the tables are made anew."""
        if self._seen is None:
            files = self.spark.read.format("binaryFile").load(f"{self.sf_dir}/events.parquet").agg(F.count("*"), F.sum("length"), F.max("modificationTime"))
            self._seen = tuple(map(str, files.first()))
        return self._seen

    def _once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._state(), name)
        if key not in _stored:
            path = os.path.join(shared_folder(self.spark), "tables", f"{name}-{uuid.uuid4().hex}")
            build().write.parquet(path)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])

    @property
    def lines(self):
        """Dealt out to all cores where the input has fewer files than there are cores: parsing is the costly part."""

        def build():
            found, cores = derived.access_log(self.spark, self.sf_dir), self.spark.sparkContext.defaultParallelism
            return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)

        return self._once("access_log", build)

    @property
    def parsed(self):
        return self._once("parsed", lambda: parse.parse_lines(self.lines))

    @property
    def entries(self):
        return parse.entries_of(self.parsed)

    @property
    def raw(self):
        return self._once("reputation_raw", lambda: derived.reputation_raw(self.spark, self.sf_dir))

    @property
    def reputation(self):
        return self._once("reputation", lambda: enrich.normalize_all(self.raw))

    @property
    def latest(self):
        return enrich.latest_reputation(self.reputation)

    @property
    def geo(self):
        return self._once("geo", lambda: detect.attach_country(self.entries, self.reputation))

    @property
    def findings(self):
        return self._once("findings", lambda: findings.all_findings(self.entries, reputation=self.reputation, store=Store(self)))

    @property
    def scored(self):
        return self._once("scored", lambda: score.composite_risk(enrich.enrich_findings(self.findings, self.latest)))


class Store:
    """Writes the shared parts of one evaluation to the folder of the tables, each once, and reads them back."""

    def __init__(self, tables: Tables):
        self.spark, self.path = tables.spark, os.path.join(shared_folder(tables.spark), "tables", "parts-" + uuid.uuid4().hex)

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = os.path.join(self.path, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class FullTables(Tables):
    """With reputation of all addresses (REPUTATION_ALL); the lines are shared with Tables."""

    def _once(self, name: str, build) -> DataFrame:
        return super()._once(name if name in ("access_log", "parsed") else name + "_full", build)

    @property
    def raw(self):
        return self._once("reputation_raw", lambda: derived.reputation_raw(self.spark, self.sf_dir, derived.REPUTATION_ALL))


def _log_files(t: Tables) -> str:
    """The derived log written as text, for the operators that read files."""
    path = os.path.join(shared_folder(t.spark), "logs-" + uuid.uuid4().hex)
    t.lines.orderBy("line_number").select("content").write.text(path)
    return path


def _read_lines(t: Tables) -> DataFrame:
    lines = logs.decode_lines(logs.read_log_lines(t.spark, _log_files(t)))
    # the log lies in files in the order of their names: lines before a file and the number in it give the place in all
    n = lines.groupBy("file_path").agg(F.max("line_number").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return lines.join(before, "file_path").select((F.col("before") + F.col("line_number")).alias("line_number"), "content", "encoding")


def _mixed_files(t: Tables) -> str:
    """The derived log in folders of three kinds: with an accent in every line, as UTF-8 and as Latin-1, and without."""
    path = os.path.join(shared_folder(t.spark), "logs-" + uuid.uuid4().hex)
    accent, part = F.concat("content", F.lit("\u00e9")), F.col("line_number") % 3
    for k, (folder, content) in enumerate((("utf8", accent), ("old/latin", F.encode(accent, "ISO-8859-1").cast("string")), ("old/plain", F.col("content")))):
        t.lines.where(part == k).select(content.alias("content")).write.text(os.path.join(path, folder))
    return path


def _decoded_files(t: Tables) -> DataFrame:
    path = _mixed_files(t)
    return logs.decode_files(logs.read_log_lines(t.spark, path), list_files(t.spark, path, encoding=True)).select("content", "encoding", "decode_error")


def _inventory(t: Tables) -> DataFrame:
    i = logs.file_inventory(t.spark, _log_files(t))
    return i.agg(F.sum("file_size").alias("file_size"), F.sum("line_count").alias("line_count"), F.count_if("is_empty").alias("empty_files"), F.max("encoding").alias("encoding"))


def _summary(t: Tables) -> DataFrame:
    path = _log_files(t)
    s = logs.ingestion_summary(logs.read_log_lines(t.spark, path), logs.file_inventory(t.spark, path))
    return s.agg(F.sum("lines_processed").alias("lines_processed"), F.sum(F.size("errors")).alias("errors"))


def _written(t: Tables) -> DataFrame:
    path = _log_files(t) + "-findings"
    logs.write_findings(detect.failed_login_pattern(t.entries).select("ip", "risk_score"), path)
    return t.spark.read.parquet(path)


def _ref(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("ip", *keep, "risk_score", F.col("ref.line_number").alias("ref_line"))


def _status(t):
    d = detect.ip_status_distribution(t.entries)
    return d.select("ip", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("statuses"), "total")


def _norm(df):
    return df.select("ip", "provider", "query_ts", "is_malicious", "confidence_score", "country_code", "organization", "abuse_reports", "reputation_score", "threat_types")


def _enriched(t):
    e = enrich.enrich_findings(detect.failed_login_pattern(t.entries), t.latest)
    return e.select("ip", "risk_score", F.array_join("providers_successful", "|").alias("providers_successful"), F.array_join("providers_failed", "|").alias("providers_failed"), F.col("reputation")["abuseipdb"]["confidence_score"].alias("abuse_confidence"))


def _geo(t):
    return t.geo.select("line_number", "ip", "country")


def _report(t):
    """The report's text, built from the top findings only."""
    return t.spark.createDataFrame([(score.render_report(t.scored, t.entries),)], "report string")


def _marked(lines: DataFrame) -> DataFrame:
    """A parser of another format: the derived log's lines of the form `garbage line N`."""
    n = F.regexp_extract("content", "^garbage line ([0-9]+)$", 1)
    none = {"ip": F.lit("127.0.0.1"), "ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "status": F.lit(200), "bytes_sent": n.try_cast("bigint"), "request_line": F.concat(F.lit("GARBAGE "), n), "path": n, "raw_line": F.col("content"), **{c: F.lit(None).cast("string") for c in ("user_agent", "referer", "remote_user")}}
    return lines.select("file_path", "line_number", *(v.alias(k) for k, v in none.items()), F.when(n == "", "no").alias("error"))


def _with_parser(t):
    registry.register_parser("marked", _marked)
    try:
        return parse.parse_stats(parse.parse_lines(t.lines), "file_path").select("file_path", "total", "successful", "errors")
    finally:
        registry.unregister("marked")


def _third(k: int):
    """A parser of the lines `garbage line N` of which N leaves k when divided by 3."""

    def parser(text):
        n = F.regexp_extract(text, "^garbage line ([0-9]+)$", 1)
        none = {c: F.lit(None).cast("string") for c in ("user_agent", "referer", "remote_user")}
        values = {"ip": F.lit(f"127.0.0.{k}"), "ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "status": F.lit(200 + k), "bytes_sent": n.try_cast("bigint") * (k + 1), "request_line": F.concat(F.lit("GARBAGE "), n), "path": n, **none}
        return F.struct(*(v.alias(c) for c, v in values.items()), F.when(n.try_cast("bigint") % 3 == k, None).otherwise("no").alias("error"))

    return parser


def _with_line_parsers(t):
    for k in range(3):
        registry.register_line_parser(f"third {k}", _third(k))
    try:
        return parse.entries_of(parse.parse_lines(t.lines)).where("request_line LIKE 'GARBAGE %'").select("line_number", "ip", "status", "bytes_sent", "path")
    finally:
        for k in range(3):
            registry.unregister(f"third {k}")


def _with_detector(t):
    def busy(entries, p):
        g = entries.groupBy("ip").agg(F.count("*").alias("n"), detect._last(detect.INPUT)).where("n >= 10")
        return g.select("ip", F.lit("Busy Address").alias("finding_type"), F.lit("busy").alias("pattern_type"), F.lit(33).alias("risk_score"), F.concat(F.lit("Busy: "), "ip").alias("description"), "ref", "n")

    registry.register_detector("busy", busy)
    try:
        return findings.all_findings(t.entries, detectors=()).where("detector = 'busy'").select("finding_type", "ip", "risk_score", "description", "ref_line", "details")
    finally:
        registry.unregister("busy")


def _items(entry: dict) -> list[dict]:
    """An entry detector: requests for items of a high number; other requests make it fail."""
    number = int(entry["request_line"].split("/item/")[1].split("?")[0])
    if number < 90:
        return []
    return [{"finding_type": "High Item", "pattern_type": "item", "risk_score": number, "description": f"Item {number}", "number": number}]


def _with_failures(t):
    """Statistics of the keyword and frequency detectors and of an entry detector that fails on many entries."""
    registry.register_entry_detector("items", _items)
    try:
        store = Store(t)
        tried = findings.by_entry(t.entries, store)
        found = findings.all_findings(t.entries, detectors=(), store=store, tried=tried)
        return findings.detector_statistics(found, t.entries, findings.failures(t.entries, tried))
    finally:
        registry.unregister("items")


def _failures(t):
    registry.register_entry_detector("items", _items)
    try:
        return findings.failures(t.entries, findings.by_entry(t.entries)).select("detector", "ref_line")
    finally:
        registry.unregister("items")


def _with_provider(t):
    def mirror(raw):
        score = F.get_json_object("body", "$.data.abuseConfidencePercentage").cast("int")
        values = {"is_malicious": score >= 90, "confidence_score": score, "country_code": F.get_json_object("body", "$.data.countryCode"), "organization": F.lit("mirror"), "abuse_reports": F.lit(0), "last_seen": F.lit(None).cast("timestamp"), "reputation_score": F.lit(None).cast("int"), "threat_types": F.array().cast("array<string>"), "additional": F.create_map().cast("map<string, string>")}
        return raw.select("ip", "provider", "query_ts", *(v.alias(k) for k, v in values.items()))

    registry.register_provider("mirror", mirror)
    try:
        raw = t.raw.unionByName(t.raw.where("provider = 'abuseipdb'").withColumn("provider", F.lit("mirror")))
        return enrich.normalize_all(raw).groupBy("provider").agg(F.count("*").alias("n"), F.count_if("is_malicious").alias("malicious"), F.sum("confidence_score").alias("scores"))
    finally:
        registry.unregister("mirror")


QUERIES = {
    "read_log_lines": _read_lines,
    "decode_lines": lambda t: logs.decode_lines(t.lines).groupBy("encoding").agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars")),
    "decode_files": _decoded_files,
    "file_inventory": _inventory,
    "ingestion_summary": _summary,
    "write_findings": _written,
    "parse_access_log": lambda t: t.entries.drop("raw_line", "file_path"),
    "parse_clf_timestamp": lambda t: t.entries.groupBy("ts").agg(F.count("*").alias("n")),
    "validate_ip": lambda t: t.parsed.where("error LIKE 'Invalid IP%'").select("line_number", "error"),
    "validate_status": lambda t: t.parsed.where("error LIKE 'Invalid HTTP status%'").select("line_number", "error"),
    "normalize_fields": lambda t: t.entries.agg(*(F.count(c).alias(c) for c in ("bytes_sent", "remote_user", "referer", "user_agent"))),
    "parse_errors": lambda t: parse.parse_errors(t.parsed).select("line_number", "error", "raw_line"),
    "parse_stats": lambda t: parse.parse_stats(t.parsed, "file_path"),
    "request_path": lambda t: t.spark.read.parquet(f"{t.sf_dir}/pages.parquet").select("page_id", request_path(F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1"))).alias("path")),
    "unpivot_targets": lambda t: keyword.unpivot_targets(t.entries).select("line_number", "field", "text"),
    "url_decode_text": lambda t: t.entries.select("line_number", url_decode_text(F.col("request_line")).alias("decoded")),
    **{f"keyword_{k}": (lambda t, g=g: keyword.keyword_findings(t.entries, (g,)).select("line_number", "field", "pattern_type", "risk_score", "matched_text")) for k, g in (("sqli", "sql_injection"), ("command_exec", "command_execution"), ("xss", "xss"))},
    "keyword_findings": lambda t: keyword.keyword_findings(t.entries).select("line_number", "field", "pattern_type", "finding_type", "risk_score", "matched_text", "description"),
    "keyword_counts": lambda t: keyword.keyword_counts(keyword.keyword_findings(t.entries)),
    "pattern_selectivity": lambda t: keyword.pattern_selectivity(t.entries),
    "ip_status_distribution": _status,
    "failed_login_pattern": lambda t: _ref(detect.failed_login_pattern(t.entries), "failed_logins"),
    "high_request_frequency": lambda t: _ref(detect.high_request_frequency(t.entries), "requests"),
    "sliding_window_stats": lambda t: detect.sliding_window_stats(t.entries),
    "burst_periods": lambda t: detect.burst_periods(t.entries, LOW).select("ip", "sec", "pos", "requests"),
    "time_windowed_brute_force": lambda t: _ref(detect.time_windowed_brute_force(t.entries, LOW), "window", "max_failed"),
    "request_burst_pattern": lambda t: _ref(detect.request_burst_pattern(t.entries, LOW), "window", "max_requests"),
    "scan_periods": lambda t: detect.scan_periods(t.entries),
    "path_enumeration": lambda t: _ref(detect.path_enumeration(t.entries), "max_paths", "periods", "total_paths"),
    "scanning_tool_signature": lambda t: _ref(detect.scanning_tool_signature(t.entries).withColumn("pattern_scores", F.transform("scores", lambda x: F.concat(x["pattern"], F.lit("="), x["score"]))), "patterns", "pattern_scores", "matches", "max_score"),
    "vulnerability_scanning": lambda t: _ref(detect.vulnerability_scanning(t.entries, LOW), "total", "not_found_ratio", "forbidden_ratio", "sample_paths"),
    "dos_burst_pattern": lambda t: _ref(detect.dos_burst_pattern(t.entries, LOW), "window", "max_burst", "burst_periods"),
    "dos_burst_periods": lambda t: detect.dos_burst_periods(t.entries, LOW),
    "user_agent_rotation": lambda t: _ref(detect.user_agent_rotation(t.entries), "agents", "per_minute", "sample_agents"),
    "automated_request_pattern": lambda t: _ref(detect.automated_request_pattern(t.entries, LOW), "tiny", "tiny_ratio", "avg_size"),
    "large_request_pattern": lambda t: _ref(detect.large_request_pattern(t.entries, LARGE), "huge", "huge_ratio", "max_size"),
    "automated_session_pattern": lambda t: _ref(detect.automated_session_pattern(t.entries, LOW), "gaps", "avg_gap", "first_gaps"),
    "attach_country": _geo,
    "geo_change_periods": lambda t: detect.geo_change_periods(t.geo),
    "rapid_geographic_changes": lambda t: _ref(detect.rapid_geographic_changes(t.geo), "max_countries", "periods"),
    "high_risk_country_activity": lambda t: _ref(detect.high_risk_country_activity(t.geo, LOW), "country", "total", "failed", "rate"),
    "impossible_travel": lambda t: _ref(detect.impossible_travel(t.geo), "changes", "countries"),
    "all_findings": lambda t: t.findings.groupBy("detector", "finding_type").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk")),
    "sorted_findings": lambda t: findings.sorted_findings(t.findings).select("detector", "pattern_type", "ip", "risk_score", "ref_line"),
    "severity_counts": lambda t: findings.severity_counts(t.findings),
    "detector_statistics": lambda t: findings.detector_statistics(t.findings, t.entries),
    "detector_failures": _failures,
    "detector_statistics_with_failures": _with_failures,
    "pattern_type_counts": lambda t: findings.pattern_type_counts(t.findings),
    "extract_finding_ips": lambda t: enrich.extract_finding_ips(t.findings),
    "public_ips": lambda t: enrich.public_ips(enrich.extract_finding_ips(t.findings)),
    "normalize_abuseipdb": lambda t: _norm(enrich.normalize_abuseipdb(t.raw.where("provider = 'abuseipdb'"))),
    "normalize_virustotal": lambda t: _norm(enrich.normalize_virustotal(t.raw.where("provider = 'virustotal'"))),
    "latest_reputation": lambda t: t.latest.select("ip", "provider", "query_ts", "confidence_score", "country_code"),
    "enrich_findings": _enriched,
    "malicious_findings": lambda t: enrich.malicious_findings(detect.failed_login_pattern(t.entries), t.latest).select("ip", "risk_score"),
    "unenriched_findings": lambda t: enrich.unenriched_findings(detect.high_request_frequency(t.entries), t.latest.where("provider = 'abuseipdb'")).select("ip", "risk_score"),
    "enrichment_stats": lambda t: enrich.enrichment_stats(t.findings, t.latest),
    "composite_risk": lambda t: t.scored.select("detector", "pattern_type", "ip", "ref_line", "risk_score", "composite"),
    "risk_level": lambda t: t.scored.groupBy("level").agg(F.count("*").alias("n")),
    "priority_findings": lambda t: score.priority_findings(t.scored).select("finding_type", "ip", "composite", "level"),
    "executive_summary": lambda t: score.executive_summary(t.scored, t.entries),
    "top_threats": lambda t: score.top_threats(t.scored),
    "recommendations": lambda t: score.recommendations(t.scored),
    "format_findings": lambda t: score.format_findings(score.priority_findings(t.scored)).select("report"),
    "render_report": _report,
    "requests_by_country": lambda t: traffic.requests_by_country(t.geo),
    "top_user_agents": lambda t: traffic.top_user_agents(t.entries),
    "top_referers": lambda t: traffic.top_referers(t.entries),
    "error_analysis": lambda t: traffic.error_analysis(t.entries),
    "register_parser": _with_parser,
    "register_line_parser": _with_line_parsers,
    "register_detector": _with_detector,
    "register_provider": _with_provider,
    "errors_by_path": lambda t: traffic.errors_by_path(t.entries),
    "requests_over_time": lambda t: traffic.requests_over_time(t.entries),
}
#: What tells the findings of all detectors apart.
KEYS = ("detector", "finding_type", "pattern_type", "ip", "country", "window", "risk_score", "ref_file", "ref_line", "description")


def _all_enriched(t: Tables) -> DataFrame:
    """Findings of all detectors with the answers of all providers."""
    r = F.col("reputation")
    scores = [r[p][c].alias(f"{p}_{c}") for p in enrich.PROVIDERS for c in ("confidence_score", "is_malicious", "country_code")]
    return enrich.enrich_findings(t.findings, t.latest).select(*KEYS, "providers_queried", "providers_successful", "providers_failed", *scores)


def _all_written(t: Tables) -> DataFrame:
    """The findings of all detectors, written whole and read back."""
    path = os.path.join(shared_folder(t.spark), "findings-" + uuid.uuid4().hex)
    logs.write_findings(t.findings, path)
    return t.spark.read.parquet(path)


def _history(t: Tables) -> DataFrame:
    """The history of reputation, kept up to date by two batches whose times overlap."""
    root = os.path.join(shared_folder(t.spark), "history-" + uuid.uuid4().hex)
    for k in range(2):
        history.update_history(t.spark, root, t.reputation.where(F.col("query_ts").isNotNull() & (F.second("query_ts") % 2 == k)), f"batch-{k}", 8)
    return history.read_history(t.spark, root).select("ip", "provider", "valid_from", "valid_to", "confidence_score", "country_code")


def _geo_by_history(t: Tables) -> DataFrame:
    known = history.history(t.reputation.where("provider = 'abuseipdb' AND country_code IS NOT NULL"))
    return history.attach_valid(t.entries, known).select("line_number", "ip", "country")


WRITTEN = (*KEYS, "ref_ts", "request_line", "status", "user_agent", "referer", "bytes_sent")


def _published(t: Tables) -> DataFrame:
    """The findings of all detectors, published in two runs, the second of them repeated."""
    root = os.path.join(shared_folder(t.spark), "published-" + uuid.uuid4().hex)
    for run, which in (("high", "risk_score >= 70"), ("other", "risk_score < 70"), ("other", "risk_score < 70")):
        publish.publish(t.findings.where(which), root, run)
    return publish.published(t.spark, root).select(*WRITTEN)


QUERIES |= {
    "reputation_history": _history,
    "attach_country_valid": _geo_by_history,
    "publish_findings": _published,
    "enrich_all_findings": _all_enriched,
    "malicious_all_findings": lambda t: enrich.malicious_findings(t.findings, t.latest).select(*KEYS),
    "unenriched_all_findings": lambda t: enrich.unenriched_findings(t.findings, t.latest).select(*KEYS),
    "write_all_findings": _all_written,
    "written_findings": lambda t: _all_written(t).select(*WRITTEN),
}

#: The queries over reputation, again over the reputation of all addresses.
FULL = ["attach_country", "geo_change_periods", "rapid_geographic_changes", "high_risk_country_activity", "impossible_travel", "all_findings", "sorted_findings", "severity_counts", "detector_statistics", "pattern_type_counts", "extract_finding_ips", "public_ips", "normalize_abuseipdb", "normalize_virustotal", "latest_reputation", "enrich_findings", "malicious_findings", "unenriched_findings", "enrich_all_findings", "malicious_all_findings", "unenriched_all_findings", "write_all_findings", "written_findings", "enrichment_stats", "composite_risk", "risk_level", "priority_findings", "executive_summary", "top_threats", "recommendations", "format_findings", "render_report", "requests_by_country", "register_provider", "reputation_history", "attach_country_valid"]
QUERIES |= {f"{name}_full": (lambda t, build=QUERIES[name]: build(FullTables(t.spark, t.sf_dir))) for name in FULL}


def _query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wide(build(Tables(spark, sf_dir)))

    return run


def queries() -> dict:
    return {name: _query(build) for name, build in QUERIES.items()}
