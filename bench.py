"""Times the headline queries and prints one JSON line: each is run once to warm up and then RUNS times; the median counts.

The log and the reputation are derived and stored first. Parsing, travel with its as-of join, the assembly of findings
(with the writes of its shared parts) and enrichment with scoring are timed from the stored lines, entries and findings,
not from their own stored results; reading the log's events and writing them as lines is reported apart, as setup.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
HEADLINE = ["parse_access_log", "keyword_findings", "failed_login_pattern", "sliding_window_stats", "path_enumeration", "scanning_tool_signature", "impossible_travel", "all_findings", "composite_risk"]
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from gatewarden.operators import detect, enrich, findings, parse, score
    from gatewarden.plans import queries as plans

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    t = plans.Tables(spark, sf)
    n = t.lines.count()
    for name in ("parsed", "reputation", "findings"):
        getattr(t, name)
    setup = round(time.time() - began, 3)
    own = {"parse_access_log": lambda: parse.entries_of(parse.parse_lines(t.lines)), "all_findings": lambda: findings.all_findings(t.entries, reputation=t.reputation, store=plans.Store(t)), "impossible_travel": lambda: detect.impossible_travel(detect.attach_country(t.entries, t.reputation)), "composite_risk": lambda: score.composite_risk(enrich.enrich_findings(t.findings, t.latest))}
    registered, times = plans.queries(), {}
    for name in HEADLINE:
        build, taken = own.get(name, lambda name=name: registered[name](spark, sf)), []
        for _ in range(1 + RUNS):
            began = time.time()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.time() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "lines": n, "setup_sec": setup}))
    spark.stop()


if __name__ == "__main__":
    main()
