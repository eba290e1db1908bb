"""Edge rows of the parser, the sliding windows and the scores."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gatewarden.functions.text import is_public, request_path, url_decode_text, valid_ip
from gatewarden.operators import detect, enrich, parse, registry
from gatewarden.operators.windows import window_counts, window_distinct
from gatewarden.sources import logs

LINE = '1.2.3.4 - - [%s] "%s" %s %s'


def parsed(spark, *lines):
    df = spark.createDataFrame([("f", k + 1, x) for k, x in enumerate(lines)], "file_path string, line_number long, content string")
    return {r.line_number: r for r in parse.parse_access_log(df).collect()}


def test_parser_edges(spark):
    at = "1/jan/2024:1:2:3 +0000"
    got = parsed(spark, LINE % (at, "GET / HTTP/1.1", 200, "-"), LINE % (at, "-", 599, 5), LINE % (at, "GET /", 600, 5), LINE % (at, "GET /", 99, 5), LINE % (at, "GET /", 200, "12x"), LINE % ("31/Feb/2024:00:00:00 +0000", "GET /", 200, 1), LINE % ("01/Jan/2024:00:00:00", "GET /", 200, 1), "  ", "junk", '::1 - u [01/Jan/2024:00:00:00 +0000] "GET / X" 200 1 "-" "" tail', '999.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET / X" 200 1', '01.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "G" 200 1', '1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /" 200 1 "a\\"b" "ua"')
    assert got[1].error is None and got[1].bytes_sent is None and got[1].ts == datetime(2024, 1, 1, 1, 2, 3)
    assert got[2].error is None and got[2].path is None
    assert got[3].error.startswith("Invalid HTTP") and got[4].error.startswith("Invalid HTTP")
    assert got[5].error.startswith("Invalid bytes") and got[6].error.startswith("Invalid timestamp") and got[7].error.startswith("Invalid timestamp")
    assert got[8].error == "Empty log line" and got[9].error.startswith("Line does not match")
    assert got[10].error is None and got[10].user_agent == "" and got[10].referer is None and got[10].remote_user == "u"
    assert got[11].error.startswith("Invalid IP") and got[12].error.startswith("Invalid IP")
    assert got[13].error is None and got[13].user_agent is None


def one(spark, fn, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(fn(F.col("v"))).collect()]


def test_text_functions(spark):
    assert one(spark, url_decode_text, ["%2527", "a+b", "%zz", "%", "%C3%A9"]) == ["%27", "a+b", "%zz", "%", "é"]
    assert one(spark, request_path, ["GET /a;p?x#f H", "GET http://h/p?q H", "GET //h/p H", "GET * H", "GET"]) == ["/a", "/p", "/p", "*", None]
    assert one(spark, valid_ip, ["1.2.3.4", "256.1.1.1", "::1", "2001:db8::1", "::ffff:1.2.3.4", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "host"]) == [True, False, True, True, True, False, True, False, False]
    assert one(spark, is_public, ["8.8.8.8", "10.1.1.1", "192.0.0.9", "192.0.0.8", "::1", "2001:4860::1"]) == [True, False, True, False, False, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_match_a_loop(spark, seed):
    rng = random.Random(seed)
    data = sorted((rng.choice("ab"), rng.randrange(200), k, rng.choice(["x", "y", "z", None]), rng.randrange(2)) for k in range(150))
    rows, count = [], {}
    for ip, sec, k, item, failed in data:
        count[ip] = count.get(ip, 0) + 1
        rows.append((ip, sec, count[ip], item, failed))
    df = spark.createDataFrame(rows, "ip string, sec long, pos int, item string, failed int").repartition(3)
    counts = {(r.ip, r.pos): (r.requests, r.flagged) for r in window_counts(df, {"w": 20}).collect()}
    distinct = {(r.ip, r.pos): r.n_distinct for r in window_distinct(df, 20, "item").collect()}
    for ip, sec, pos, _, _ in rows:
        seen = [r for r in rows if r[0] == ip and r[2] >= pos and r[1] <= sec + 20]
        assert counts[ip, pos] == (len(seen), sum(r[4] for r in seen))
        assert distinct[ip, pos] == len({r[3] for r in seen} - {None})


def entries(spark, rows):
    base = datetime(2024, 1, 1)
    full = [("f", k + 1, ip, base + timedelta(seconds=s), "GET /a H", status, "ua", 1, None, "/a", country) for k, (ip, s, status, country) in enumerate(rows)]
    return spark.createDataFrame(full, "file_path string, line_number long, ip string, ts timestamp_ntz, request_line string, status int, user_agent string, bytes_sent long, referer string, path string, country string")


def test_travel_runs_from_the_first_row(spark):
    got = {r.ip: r.changes for r in detect.impossible_travel(entries(spark, [("a", 0, 200, "DE"), ("a", 1799, 200, "FR"), ("b", 0, 200, "DE"), ("b", 600, 200, "DE"), ("b", 1800, 200, "FR")])).collect()}
    assert got == {"a": 1}


def test_session_gaps(spark):
    rows = [("a", 5 * k, 200, None) for k in range(11)] + [("b", 5 * k, 200, None) for k in range(11)] + [("b", 109, 200, None)] + [("c", 5 * k, 200, None) for k in range(11)] + [("c", 110, 200, None)]
    got = {r.ip: r.gaps for r in detect.automated_session_pattern(entries(spark, rows)).collect()}
    assert got == {"a": 10, "c": 11}


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("één\r\ntwo\n".encode() + b"caf\xe9\n")
    (tmp_path / "b.log").write_bytes(b"")
    lines = logs.decode_lines(logs.read_log_lines(spark, str(tmp_path)))
    assert [(r.line_number, r.content, r.encoding) for r in lines.orderBy("line_number").collect()] == [(1, "één", "utf-8"), (2, "two", "utf-8"), (3, "café", "latin-1")]
    assert sorted((r.line_count, r.is_empty) for r in logs.file_inventory(spark, str(tmp_path)).collect()) == [(0, True), (3, False)]


def test_registry():
    registry.register_detector("mine", lambda e, p: e)
    assert "mine" in registry.detectors()
    registry.unregister("mine")
    assert "mine" not in registry.detectors()


def test_line_with_the_mark_of_the_parser(spark):
    at = "01/Jan/2024:00:00:00 +0000"
    got = parsed(spark, LINE % (at, "GET /a\u0001b/c HTTP/1.1", 200, 7), "\u0001 junk", LINE % (at, "GET / H", 200, 1) + ' "r\u0001" "ua"')
    assert got[1].error is None and got[1].request_line == "GET /a\u0001b/c HTTP/1.1" and got[1].bytes_sent == 7
    assert got[2].error.startswith("Line does not match") and got[3].referer == "r\u0001" and got[3].user_agent == "ua"


def test_registered_parser_and_provider(spark):
    lines = spark.createDataFrame([("f", 1, "junk 7"), ("f", 2, LINE % ("01/Jan/2024:00:00:00 +0000", "GET / H", 200, 1)), ("f", 3, "other")], "file_path string, line_number long, content string")
    registry.register_parser("junk", lambda df: parse.parse_access_log(df.withColumn("content", F.when(F.col("content").startswith("junk"), F.lit(LINE % ("01/Jan/2024:00:00:00 +0000", "GET /j H", 201, 1))).otherwise(F.col("content")))))
    try:
        got = {r.line_number: (r.error is None, r.path) for r in parse.parse_lines(lines).collect()}
    finally:
        registry.unregister("junk")
    assert got == {1: (True, "/j"), 2: (True, "/"), 3: (False, None)}
    assert {r.line_number for r in parse.parse_lines(lines).where("error IS NULL").collect()} == {2}


def test_reputation_values(spark):
    body = '{"data":{"attributes":{"last_analysis_date":86400,"last_analysis_stats":{"malicious":29,"suspicious":0,"harmless":71,"undetected":0,"timeout":5},"last_analysis_results":{"a":{"category":"malicious","result":"TROJAN.generic-x"}},"total_votes":{"harmless":1,"malicious":2}}}}'
    raw = spark.createDataFrame([("1.1.1.1", "virustotal", datetime(2024, 1, 1), body)], "ip string, provider string, query_ts timestamp_ntz, body string")
    r = enrich.normalize_virustotal(raw).first()
    assert (r.confidence_score, r.threat_types, r.last_seen, r.additional["malicious_votes"]) == (28, ["Trojan.Generic-X"], datetime(1970, 1, 2), "2")


def test_addresses_between_word_boundaries(spark):
    df = spark.createDataFrame([("9.9.9.9", "see 8.8.4.4. and v1.1.1.1 and 1.2.3.4.5 256.1.1.1", None, None)], "ip string, request_line string, user_agent string, referer string")
    assert {r.ip for r in enrich.extract_finding_ips(df).collect()} == {"9.9.9.9", "8.8.4.4", "1.2.3.4"}


def test_dos_risk_and_periods_follow_the_threshold(spark):
    from dataclasses import replace

    p = replace(detect.DEFAULT, dos_burst_threshold=20)
    rows = [("a", 0, 200, None)] * 25 + [("a", 1, 200, None)] * 5 + [("b", 40 * k, 200, None) for k in range(30)]
    one = entries(spark, rows)
    got = {r.ip: (r.max_burst, r.window, r.risk_score, r.burst_periods) for r in detect.dos_burst_pattern(one, p).collect()}
    periods = detect.dos_burst_periods(one, p)
    assert got == {"a": (30, "30sec", 81, 11 * 4)} and periods.count() == 44 and {r.duration for r in periods.collect()} == {30, 60, 120, 300}


def test_changed_input_is_read_again(spark, tmp_path):
    from gatewarden.plans import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    counts = []
    for n in (50, 80):
        events.limit(n).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        counts.append(queries.Tables(spark, str(tmp_path)).lines.count())
    assert counts == [50, 80]
