"""Composite risk, levels, priorities, summary and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_case
from .findings import severity_counts


def composite_risk(enriched: DataFrame) -> DataFrame:
    """Adds composite and level. Terms are summed in a fixed order, so that the cut to a whole number agrees."""
    values = F.coalesce(F.map_values("reputation"), F.array().cast(enriched.select(F.map_values("reputation")).schema[0].dataType))
    worst = F.array_max(F.transform(F.filter(values, lambda r: r["is_malicious"]), lambda r: r["confidence_score"] / F.lit(100.0) * 0.4))
    reputation = F.coalesce(worst, F.lit(0.0))
    has = lambda *names: F.col("pattern_type").rlike("|".join(names))
    frequency = F.when(has("brute_force", "dos_burst", "scanning", "behavioral_anomaly"), 0.3).when(has("frequency", "time_windowed", "geographic"), 0.2).otherwise(0.1)
    weight = F.create_map(F.lit("CN"), F.lit(0.1), F.lit("RU"), F.lit(0.15), F.lit("KP"), F.lit(0.2), F.lit("IR"), F.lit(0.15))
    country = F.coalesce(*(F.try_element_at("reputation", F.lit(k))["country_code"] for k in ("abuseipdb", "virustotal")))
    geography = F.coalesce(weight[country], F.lit(0.0))
    composite = F.least((F.col("risk_score") + reputation * 0.4 * 100 + frequency * 0.3 * 100 + geography * 0.2 * 100).cast("int"), F.lit(100))
    return enriched.withColumn("composite", composite).withColumn("level", risk_level("composite"))


def risk_level(score: str):
    c = F.col(score)
    return F.when(c >= 90, "Critical").when(c >= 70, "High").when(c >= 40, "Medium").otherwise("Low")


ORDER = ("risk_score", "detector", "pattern_type", "ip", "ref_line", "window", "finding_type", "details")


def _ordered():
    return [F.desc("composite"), F.desc("risk_score"), *ORDER[1:]]


def priority_findings(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.orderBy(*_ordered()).limit(k)


def top_threats(scored: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent finding types; ties by the best finding of the type."""
    best = F.min(F.struct(-F.col("composite"), -F.col("risk_score"), *ORDER[1:]))
    return scored.groupBy("finding_type").agg(F.count("*").alias("n"), best.alias("b")).orderBy(F.desc("n"), "b").limit(k).select("finding_type", "n")


def executive_summary(scored: DataFrame, entries: DataFrame) -> DataFrame:
    n = entries.agg(F.count("*").alias("entries"))
    s = scored.agg(F.min("ref_ts").alias("period_start"), F.max("ref_ts").alias("period_end"), F.count("*").alias("findings"), F.count_if(F.col("composite") >= 70).alias("critical_high"), F.count_distinct("finding_type").alias("finding_types"))
    return s.crossJoin(n)


def recommendations(scored: DataFrame) -> DataFrame:
    """One row: the list of advice that the findings call for, a fixed line if none; with the malicious addresses."""
    bad = F.coalesce(F.exists(F.map_values("reputation"), lambda r: r["is_malicious"]), F.lit(False))
    g = scored.agg(F.count_if(F.col("composite") >= 70).alias("urgent"), F.count_if(F.col("finding_type").contains("Brute Force")).alias("brute"), F.count_if(F.col("finding_type").contains("Scanning")).alias("scan"), F.count_if(F.col("finding_type").contains("SQL")).alias("sql"), F.count_if(bad).alias("malicious"), F.count_distinct(F.when(bad, F.col("ip"))).alias("malicious_ips"))
    advice = F.array_compact(F.array(
        F.when(F.col("urgent") > 0, F.concat(F.lit("Investigate "), "urgent", F.lit(" critical or high findings at once"))),
        F.when(F.col("brute") > 0, F.lit("Limit login attempts and lock accounts under attack")),
        F.when(F.col("scan") > 0, F.lit("Block scanners at the firewall")),
        F.when(F.col("sql") > 0, F.lit("Review input checks against SQL injection")),
        F.when(F.col("malicious") > 0, F.concat(F.lit("Block "), "malicious", F.lit(" IPs with a malicious reputation"))),
    ))
    return g.select(F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("No action needed; keep monitoring"))).alias("recommendations"), "malicious", "malicious_ips")


def format_findings(scored: DataFrame, verbose: bool = False) -> DataFrame:
    """scored with a text of several lines for each finding."""
    agent = F.when(F.char_length("user_agent") > 60, F.concat(F.substring("user_agent", 1, 60), F.lit("..."))).otherwise(F.col("user_agent"))
    providers = F.transform(F.map_entries("reputation"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.when(e["value"]["is_malicious"], "malicious").otherwise("clean"), F.lit(" ("), e["value"]["confidence_score"], F.lit("%)")))
    pattern = F.concat(F.lit("  Pattern: "), title_case(F.replace("pattern_type", F.lit("_"), F.lit(" "))), F.coalesce(F.concat(F.lit(" (Window: "), "window", F.lit(")")), F.lit("")))
    lines = [F.concat(F.lit("["), "level", F.lit("] "), "finding_type", F.lit(" - risk "), "composite"), F.concat(F.lit("  "), "description"), F.concat(F.lit("  IP: "), "ip"), F.concat(F.lit("  Time: "), F.date_format("ref_ts", "yyyy-MM-dd HH:mm:ss")), pattern, F.array_join(providers, "\n"), F.concat(F.lit("  ISP: "), F.try_element_at("reputation", F.lit("virustotal"))["organization"])]
    if verbose:
        lines += [F.concat(F.lit("  Request: "), "request_line"), F.concat(F.lit("  Status: "), "status"), F.when(agent != "", F.concat(F.lit("  Agent: "), agent)), F.when(F.col("bytes_sent") > 0, F.concat(F.lit("  Bytes sent: "), F.format_number("bytes_sent", 0)))]
    return scored.withColumn("report", F.concat_ws("\n", *lines))


def render_report(scored: DataFrame, entries: DataFrame, verbose: bool = False) -> str:
    """The report as one text; only the top findings and one-row summaries reach the driver."""
    s = executive_summary(scored, entries).first()
    if not s["findings"]:
        return f"No threats found in {s['entries']} entries.\n"
    c = severity_counts(scored).first()
    top = [r["report"] for r in format_findings(priority_findings(scored, 10 if verbose else 5), verbose).select("report").collect()]
    threats = [f"  {r['finding_type']}: {r['n']}" for r in top_threats(scored).collect()]
    advice = [f"  - {x}" for x in recommendations(scored).first()["recommendations"]]
    head = f"Period: {s['period_start']} to {s['period_end']}\nEntries: {s['entries']}  Findings: {s['findings']} (high {c['high']}, medium {c['medium']}, low {c['low']}, info {c['info']})"
    return "\n\n".join([head, "Top threats:\n" + "\n".join(threats), *top, "Recommendations:\n" + "\n".join(advice)]) + "\n"
