"""Windows, paths and travel in ranges, the shared sums and the failures of detectors, against plain Python."""

import random
from collections import Counter, defaultdict
from dataclasses import replace
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from gatewarden.operators import detect, findings, registry, windows
from gatewarden.params import DEFAULT
from gatewarden.plans import queries

SCHEMA = "file_path string, line_number long, ip string, ts timestamp_ntz, request_line string, status int, raw_line string, user_agent string, bytes_sent long, referer string, remote_user string, path string, country string"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for k in range(420):
        ip = rng.choice(["hot"] * 6 + ["b", "c"])
        at = rng.choice([rng.randrange(0, 400), rng.randrange(100, 130), rng.randrange(5000, 5200)])
        path = rng.choice([None, *(f"/p{j}" for j in range(9))])
        agent = rng.choice([None, "", *(f"a{j}" for j in range(7))])
        out.append((rng.choice(["f1", "f2"]), k, ip, T0 + timedelta(seconds=at), f"GET {path} " + "x" * rng.randrange(0, 30), rng.choice([200, 401, 403, 404]), "r", agent, 1, None, None, path, rng.choice(["DE", "FR", "CN", "RU"])))
    return out


@pytest.fixture(scope="module")
def entries(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(autouse=True)
def short_ranges(monkeypatch):
    for module in (windows, detect):
        monkeypatch.setattr(module, "SPAN", 17)
    monkeypatch.setattr(windows, "ROWS", 11)


def in_time(rows):
    """ip -> [(second, row)] in time order."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[3], r[0], r[1])):
        out[r[2]].append((int((r[3] - T0).total_seconds()), r))
    return out


def test_windows_in_ranges(spark, rows, entries):
    sizes = {"a": 7, "b": 60, "c": 900}
    placed = windows.positioned(entries)
    counts = {(r.ip, r.window, r.pos): (r.requests, r.flagged) for r in windows.window_counts(placed, sizes).collect()}
    distinct = {(r.ip, r.pos): r.n_distinct for r in windows.window_distinct(placed, 60, "path").collect()}
    assert len(counts) == 3 * len(rows) and len(distinct) == len(rows)
    for ip, own in in_time(rows).items():
        for k, (sec, _) in enumerate(own):
            for name, w in sizes.items():
                inside = [r for t, r in own[k:] if t <= sec + w]
                assert counts[ip, name, k + 1] == (len(inside), sum(r[5] in (401, 403) for r in inside))
            assert distinct[ip, k + 1] == len({r[11] for t, r in own[k:] if t <= sec + 60} - {None})


@pytest.mark.parametrize("least", [4, 7, 9])
def test_path_periods_from_seconds(rows, entries, least):
    p = replace(DEFAULT, scan_window=30, unique_paths_threshold=least)
    got = {r.ip: (r.max_paths, r.periods) for r in detect.path_enumeration(entries, p).collect()}
    want = {}
    for ip, own in in_time(rows).items():
        seen = [len({r[11] for t, r in own[k:] if t <= sec + 30} - {None}) for k, (sec, _) in enumerate(own)]
        if max(seen) >= least:
            want[ip] = (max(seen), sum(n >= least for n in seen))
    assert got == want


@pytest.mark.parametrize("limit", [5, 40, 1800])
def test_travel_from_summaries(rows, entries, limit):
    p = replace(DEFAULT, travel_seconds=limit)
    got = {r.ip: (r.changes, r.countries, r.ref.line_number) for r in detect.impossible_travel(entries, p).collect()}
    want = {}
    for ip, own in in_time(rows).items():
        was, began, quick, seen, last = own[0][1][12], own[0][0], 0, set(), None
        for sec, r in own[1:]:
            if r[12] != was:
                if sec - began < limit:
                    quick, seen, last = quick + 1, seen | {was, r[12]}, r[1]
                was, began = r[12], sec
        if quick:
            want[ip] = (quick, sorted(seen), last)
    assert got == want


def each_alone(entries, geo, p):
    """Every detector by its own function, as the shared evaluation has to give them."""
    alone = {"frequency": (detect.failed_login_pattern, detect.high_request_frequency, detect.time_windowed_brute_force, detect.request_burst_pattern), "scanning": (detect.path_enumeration, detect.scanning_tool_signature, detect.vulnerability_scanning), "behavioral": (detect.dos_burst_pattern, detect.user_agent_rotation, detect.automated_request_pattern, detect.large_request_pattern, detect.automated_session_pattern), "geographic": (detect.rapid_geographic_changes, detect.high_risk_country_activity, detect.impossible_travel)}
    for group, functions in alone.items():
        for f in functions:
            yield from findings._common(f(geo if group == "geographic" else entries, p), group).collect()


def test_shared_sums_give_the_same(spark, entries):
    p = replace(queries.LOW, high_frequency_threshold=20, failed_login_threshold=3, tiny_bytes=20, tiny_ratio=0.1, tiny_count=2, huge_bytes=25, huge_ratio=0.05, unique_paths_threshold=6, scan_window=30, vuln_ratio=0.05, geo_change_threshold=2)
    e = entries.drop("country")
    # some times of day without a known country, and changes of country between seconds
    known = spark.createDataFrame([("abuseipdb", ip, T0 + timedelta(seconds=s), c) for ip in ("hot", "b") for s, c in ((50, "DE"), (110, "CN"), (120, "RU"), (121, "CN"), (5100, "FR"))], "provider string, ip string, query_ts timestamp_ntz, country_code string")
    got = Counter(map(str, (r for r in findings.all_findings(e, p, reputation=known).collect() if r.detector != "keyword")))
    want = Counter(map(str, each_alone(e, detect.attach_country(e, known), p)))
    assert got == want and len(want) > 15


def test_failures(spark, entries):
    def fussy(entry):
        number = int(entry["request_line"].split("/p")[1].split()[0])
        return [{"finding_type": "P", "pattern_type": "p", "risk_score": 60, "description": f"p{number}", "number": number}] if number == 3 else []

    bad = spark.createDataFrame([("f3", 1, None, T0, "GET /p3 x", 200, "r", None, 1, None, None, "/p3", "DE"), ("f3", 2, "b", None, "GET /q x", 200, "r", None, 1, None, None, None, "DE")], SCHEMA)
    all_ = entries.unionByName(bad).drop("country")
    registry.register_entry_detector("fussy", fussy)
    try:
        tried = findings.by_entry(all_)
        found = findings.all_findings(all_, detectors=(), tried=tried)
        failed = findings.failures(all_, tried)
        got = {r.detector: r.asDict() for r in findings.detector_statistics(found, all_, failed).collect()}
        assert {e for (e,) in failed.where("detector = 'fussy'").select("error").collect()} == {"IndexError: list index out of range"}
    finally:
        registry.unregister("fussy")
    # the same counts by SQL over the fixture
    c = duckdb.connect()
    c.register("e", all_.select("ip", "ts", "request_line").withColumn("ts", F.col("ts").cast("string")).toPandas())
    n, fails, hits, lacking = c.sql(r"SELECT count(*), count(*) FILTER (NOT regexp_matches(request_line, '/p[0-9]')), count(*) FILTER (contains(request_line, '/p3')), count(*) FILTER (ip IS NULL OR ts IS NULL) FROM e").fetchall()[0]
    assert fails > 10 and lacking == 2
    assert (got["fussy"]["total"], got["fussy"]["processing_errors"], got["fussy"]["entries_processed"]) == (hits, fails, n)
    assert got["fussy"]["success_rate"] == pytest.approx(100 * (n - fails) / n)
    assert got["frequency"]["processing_errors"] == got["geographic"]["processing_errors"] == lacking and got["geographic"]["total"] == 0
    assert all(r.ip is not None for r in found.where("detector = 'frequency'").collect())
    none = all_.where("false")
    assert findings.detector_statistics(findings.all_findings(none), none).count() == 0
