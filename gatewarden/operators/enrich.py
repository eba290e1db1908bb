"""Reputation payloads to rows, and their joins with findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ABUSE_CATEGORIES
from ..functions.text import IPV4, is_public, title_case
from .registry import providers as registered

COLUMNS = ["ip", "provider", "query_ts", "is_malicious", "confidence_score", "country_code", "organization", "abuse_reports", "last_seen", "reputation_score", "threat_types", "additional"]
PROVIDERS = ("abuseipdb", "virustotal")


def extract_finding_ips(findings: DataFrame) -> DataFrame:
    """Distinct client addresses, and valid IPv4 addresses between word boundaries in request, agent and referer."""
    word = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
    inside = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(word), 0) for c in ("request_line", "user_agent", "referer"))))
    found = findings.select(F.explode(F.filter(inside, lambda x: x.rlike(rf"^{IPV4}$"))).alias("ip"))
    return findings.select("ip").union(found).where("ip IS NOT NULL").distinct()


def public_ips(ips: DataFrame) -> DataFrame:
    return ips.where(is_public(F.col("ip")))


def normalize_abuseipdb(raw: DataFrame) -> DataFrame:
    schema = "data struct<abuseConfidencePercentage: int, countryCode: string, domain: string, isp: string, usageType: string, totalReports: int, lastReportedAt: string, reports: array<struct<categories: array<int>>>>"
    d = raw.select("ip", "provider", "query_ts", F.from_json("body", schema)["data"].alias("d"))
    names = F.create_map(*(F.lit(x) for pair in ABUSE_CATEGORIES.items() for x in pair))
    codes = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("d.reports", F.array().cast("array<struct<categories: array<int>>>")), lambda r: r["categories"]))))
    threats = F.transform(codes, lambda c: F.coalesce(names[c], F.concat(F.lit("Category "), c)))
    score = F.coalesce("d.abuseConfidencePercentage", F.lit(0))
    extra = F.map_filter(F.create_map(F.lit("isp"), "d.isp", F.lit("usage_type"), "d.usageType"), lambda k, v: v.isNotNull())
    return d.select("ip", "provider", "query_ts", (score >= 50).alias("is_malicious"), score.alias("confidence_score"), F.col("d.countryCode").alias("country_code"), F.col("d.domain").alias("organization"), F.coalesce("d.totalReports", F.lit(0)).alias("abuse_reports"), F.try_to_timestamp("d.lastReportedAt").alias("last_seen"), F.lit(None).cast("int").alias("reputation_score"), threats.alias("threat_types"), extra.alias("additional"))


def normalize_virustotal(raw: DataFrame) -> DataFrame:
    schema = "data struct<attributes: struct<country: string, as_owner: string, asn: int, network: string, reputation: int, last_analysis_date: bigint, last_analysis_stats: map<string, int>, last_analysis_results: map<string, struct<category: string, result: string>>, total_votes: struct<harmless: int, malicious: int>>>"
    a = raw.select("ip", "provider", "query_ts", F.from_json("body", schema)["data"]["attributes"].alias("a"))
    stats = F.coalesce("a.last_analysis_stats", F.create_map().cast("map<string, int>"))
    count = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0))
    total = count("malicious") + count("suspicious") + count("harmless") + count("undetected")
    # divided first, as the cut to a whole number depends on it
    score = F.when(total > 0, ((count("malicious") + count("suspicious")) / total * 100).cast("int")).otherwise(0)
    engines = F.map_values(F.coalesce("a.last_analysis_results", F.create_map().cast("map<string, struct<category: string, result: string>>")))
    threats = F.array_sort(F.array_distinct(F.transform(F.filter(engines, lambda e: e["category"].isin("malicious", "suspicious") & e["result"].isNotNull()), lambda e: title_case(e["result"]))))
    numbers = {"asn": F.col("a.asn"), "malicious_count": count("malicious"), "suspicious_count": count("suspicious"), "clean_count": count("harmless"), "undetected_count": count("undetected"), "harmless_votes": F.coalesce("a.total_votes.harmless", F.lit(0)), "malicious_votes": F.coalesce("a.total_votes.malicious", F.lit(0))}
    extra = F.map_filter(F.create_map(*(x for k, v in numbers.items() for x in (F.lit(k), v.cast("string"))), F.lit("network"), "a.network"), lambda k, v: v.isNotNull())
    return a.select("ip", "provider", "query_ts", ((count("malicious") > 0) | (score >= 25)).alias("is_malicious"), score.alias("confidence_score"), F.col("a.country").alias("country_code"), F.col("a.as_owner").alias("organization"), count("malicious").alias("abuse_reports"), F.timestamp_seconds("a.last_analysis_date").alias("last_seen"), F.col("a.reputation").alias("reputation_score"), threats.alias("threat_types"), extra.alias("additional"))


def normalize_all(raw: DataFrame) -> DataFrame:
    """The payloads of both providers and of the registered ones; a registered one takes the place of its name."""
    known = {"abuseipdb": normalize_abuseipdb, "virustotal": normalize_virustotal} | registered()
    out = None
    for name, fn in known.items():
        rows = fn(raw.where(F.col("provider") == name)).select(*COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out


def latest_reputation(reputation: DataFrame, as_of=None, ttl_seconds: int | None = None) -> DataFrame:
    """One row per address and provider: the newest, as of a time and not older than a time to live."""
    r = reputation
    if as_of is not None:
        r = r.where(F.col("query_ts") <= F.lit(as_of).cast("timestamp_ntz"))
        if ttl_seconds is not None:
            r = r.where(F.timestamp_diff("SECOND", F.col("query_ts"), F.lit(as_of).cast("timestamp_ntz")) <= ttl_seconds)
    rest = [c for c in reputation.columns if c not in ("ip", "provider")]
    return r.groupBy("ip", "provider").agg(F.max_by(F.struct(*rest), "query_ts").alias("r")).select("ip", "provider", "r.*")


def enrich_findings(findings: DataFrame, reputation: DataFrame, providers=PROVIDERS) -> DataFrame:
    """findings with the reputation of their own address by provider, and which providers answered."""
    keep = [c for c in reputation.columns if c not in ("ip", "provider")]
    by_ip = reputation.where(F.col("provider").isin(*providers)).groupBy("ip").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("provider", F.struct(*[c for c in keep if c != "additional"]).alias("r"))))).alias("reputation"))
    out = findings.join(by_ip, "ip", "left")
    queried = F.array(*map(F.lit, providers))
    got = F.coalesce(F.map_keys("reputation"), F.array().cast("array<string>"))
    return out.withColumns({"providers_queried": queried, "providers_successful": F.array_sort(got), "providers_failed": F.array_except(queried, got)})


def malicious_findings(findings: DataFrame, reputation: DataFrame) -> DataFrame:
    return findings.join(reputation.where("is_malicious").select("ip"), "ip", "left_semi")


def unenriched_findings(findings: DataFrame, reputation: DataFrame) -> DataFrame:
    return findings.join(reputation.select("ip"), "ip", "left_anti")


def enrichment_stats(findings: DataFrame, reputation: DataFrame) -> DataFrame:
    """Addresses asked, answers, misses, skipped private addresses, findings enriched, answers per 100 addresses."""
    ips = extract_finding_ips(findings).withColumn("public", is_public(F.col("ip")))
    answers = reputation.groupBy("ip").agg(F.count("*").alias("answers"))
    per_ip = ips.join(answers, "ip", "left").agg(F.count_if("public").alias("ips_queried"), F.count_if(~F.col("public")).alias("skipped_private"), F.coalesce(F.sum(F.when(F.col("public"), F.col("answers"))), F.lit(0)).alias("successful_lookups"), F.count_if(F.col("public") & F.col("answers").isNull()).alias("misses"))
    done = findings.join(reputation.select("ip"), "ip", "left_semi").agg(F.count("*").alias("findings_enriched"))
    return per_ip.crossJoin(done).withColumn("success_rate", F.when(F.col("ips_queried") > 0, F.col("successful_lookups") * 100.0 / F.col("ips_queried")).otherwise(0.0))
