"""The streams over log files give what the batch functions give."""

import pytest
from pyspark.sql import functions as F

from gatewarden.operators import keyword, parse
from gatewarden.streaming import live

LINE = '%s - - [01/Jan/2024:00:%02d:%02d +0000] "GET %s HTTP/1.1" %d 5'


def write(folder, name, lines):
    (folder / ("." + name)).write_text("".join(x + "\n" for x in lines))
    (folder / ("." + name)).rename(folder / name)  # a stream sees whole files only


def run(query):
    query.processAllAvailable()
    query.stop()


@pytest.fixture
def dirs(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", str(tmp_path / "check")


def test_keywords_of_new_files(spark, dirs):
    folder, check = dirs
    paths = ["/a?id=1%20union%20select%20x", "/b", "/c?q=<script>", "/d?c=wget%20x"]

    def sink(name):
        return live.stream_keyword_findings(spark, str(folder)).writeStream.format("memory").queryName(name).option("checkpointLocation", check)

    write(folder, "one.log", [LINE % ("1.2.3.4", 0, k, p, 200) for k, p in enumerate(paths[:2])] + ["junk", ""])
    first = sink("keywords").start()
    first.processAllAvailable()
    write(folder, "two.log", [LINE % ("1.2.3.4", 1, k, p, 200) for k, p in enumerate(paths[2:])])
    run(first)
    batch = parse.entries_of(parse.parse_access_log(spark.read.text(str(folder)).select(F.lit("f").alias("file_path"), F.lit(1).cast("long").alias("line_number"), F.col("value").alias("content"))))
    columns = ("ip", "field", "pattern_type", "pattern", "risk_score", "matched_text", "description")
    got = sorted(tuple(r) for r in spark.table("keywords").select(*columns).collect())
    assert got == sorted(tuple(r) for r in keyword.keyword_findings(batch).select(*columns).collect()) and len(got) == 3


def test_a_stream_goes_on_after_it_was_stopped(spark, dirs, tmp_path):
    folder, check = dirs
    out = str(tmp_path / "out")
    for k in range(2):
        write(folder, f"{k}.log", [LINE % (f"1.2.3.{k}", 0, 0, "/x?c=curl%20y", 200)])
        run(live.stream_keyword_findings(spark, str(folder)).select("ip", "pattern").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start())
    assert sorted(r.ip for r in spark.read.parquet(out).collect()) == ["1.2.3.0", "1.2.3.1"]


def test_failed_logins_in_windows_with_late_lines(spark, dirs):
    folder, check = dirs
    failed = live.stream_failed_logins(live.stream_entries(spark, str(folder)), threshold=3).select("ip", F.col("window.start").alias("start"), "failed")
    write(folder, "one.log", [LINE % ("9.9.9.9", 10, k, "/login", 401) for k in range(3)] + [LINE % ("8.8.8.8", 10, 0, "/login", 401)] + [LINE % ("9.9.9.9", 10, 50, "/", 200)])
    query = failed.writeStream.format("memory").queryName("failed").outputMode("append").option("checkpointLocation", check).start()
    query.processAllAvailable()
    # within the ten minutes that lines may be late: counts; then the time goes on, and windows before it are final
    write(folder, "two.log", [LINE % ("9.9.9.9", 10, 9, "/login", 403)])
    query.processAllAvailable()
    write(folder, "three.log", [LINE % ("7.7.7.7", 40, 0, "/", 401)])
    query.processAllAvailable()
    write(folder, "late.log", [LINE % ("9.9.9.9", 10, 30, "/login", 401)])
    query.processAllAvailable()
    write(folder, "end.log", [LINE % ("7.7.7.7", 59, 0, "/", 401)])
    run(query)
    got = sorted((r.ip, r.start.minute, r.failed) for r in spark.table("failed").collect())
    assert got == [("9.9.9.9", m, 4) for m in range(6, 11)]
