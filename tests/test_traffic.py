"""Most frequent values against plain counts, and registered line parsers in one pass."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewarden.operators import parse, registry, traffic


@pytest.mark.parametrize("buckets", [1, 7, 200, 1 << 16])
def test_most_frequent_values(spark, buckets):
    rng = random.Random(buckets)
    values = [f"v{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)] + ["", None] * 900
    df = spark.createDataFrame([(v,) for v in values], "user_agent string").repartition(3)
    counts = Counter(v for v in values if v)
    for k in (1, 10, 60, 2000):
        got = [(r.user_agent, r.n) for r in traffic._top(df, "user_agent", k, buckets).collect()]
        assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    # all values as frequent: ties go by their order
    even = spark.createDataFrame([(f"e{k % 500:03}",) for k in range(1500)], "user_agent string")
    assert [r.user_agent for r in traffic._top(even, "user_agent", 5, buckets).collect()] == [f"e{k:03}" for k in range(5)]
    assert traffic._top(even.limit(0), "user_agent", 5, buckets).count() == 0


def test_line_parsers_share_the_pass(spark, tmp_path):
    def shaped(word, status):
        def parser(text):
            none = {c: F.lit(None).cast("string") for c in ("user_agent", "referer", "remote_user", "request_line")}
            return F.struct(F.lit("1.1.1.1").alias("ip"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(status).alias("status"), F.lit(1).alias("bytes_sent"), F.lit("/").alias("path"), *(v.alias(k) for k, v in none.items()), F.when(text.contains(word), None).otherwise("no").alias("error"))

        return parser

    rows = [("f", 1, "one"), ("f", 2, "one two"), ("f", 3, "two"), ("f", 4, "other"), ("f", 5, None), ("f", 6, ""), ("f", 7, '1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /one H" 200 1'), ("f", 8, '999.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /one H" 200 1')]
    spark.createDataFrame(rows, "file_path string, line_number long, content string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    for name, status in (("one", 201), ("two", 202), ("zero", 203)):
        registry.register_line_parser(name, shaped(name, status))
    try:
        out = parse.parse_lines(lines)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.line_number: (r.status, r.error, r.raw_line) for r in out.collect()}
    finally:
        for name in ("one", "two", "zero"):
            registry.unregister(name)
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {1: 201, 2: 201, 3: 202, 7: 200}
    assert got[4][1] == parse.UNKNOWN and got[5][1] == got[6][1] == "Empty log line" and got[8][1].startswith("Invalid IP") and got[2][2] == "one two"
    assert parse.parse_lines(lines).where("error IS NULL").count() == 1
