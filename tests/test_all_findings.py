"""Enrichment, filters and writing over the findings of all detectors, against plain Python."""

from collections import Counter

import pytest

from gatewarden.plans import queries

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple(row[c] for c in queries.KEYS)


@pytest.mark.parametrize("suffix", ["", "_full"])
def test_all_findings_enriched(spark, suffix):
    t = (queries.FullTables if suffix else queries.Tables)(spark, SF)
    found, latest = t.findings.collect(), {(r.ip, r.provider): r for r in t.latest.collect()}
    assert len({r.detector for r in found}) >= 3 and max(Counter(r.ip for r in found).values()) > 1
    got = queries.queries()["enrich_all_findings" + suffix](spark, SF).collect()
    assert Counter(map(key, got)) == Counter(map(key, found))
    providers = ("abuseipdb", "virustotal")
    for r in got:
        answers = {p: latest[r.ip, p] for p in providers if (r.ip, p) in latest}
        assert (r.providers_successful, r.providers_failed) == ("|".join(answers), "|".join(p for p in providers if p not in answers))
        for p in providers:
            a = answers.get(p)
            assert (r[p + "_confidence_score"], r[p + "_is_malicious"], r[p + "_country_code"]) == ((a.confidence_score, a.is_malicious, a.country_code) if a else (None, None, None))
    bad = {ip for (ip, _), r in latest.items() if r.is_malicious}
    assert Counter(map(key, queries.queries()["malicious_all_findings" + suffix](spark, SF).collect())) == Counter(key(r) for r in found if r.ip in bad)


def test_all_findings_left_and_written(spark):
    t = queries.Tables(spark, SF)
    found, known = t.findings.collect(), {r.ip for r in t.latest.collect()}
    left = Counter(map(key, queries.queries()["unenriched_all_findings"](spark, SF).collect()))
    assert left == Counter(key(r) for r in found if r.ip not in known) and left
    written = queries.queries()["write_all_findings"](spark, SF)
    assert set(t.findings.columns) == set(written.columns)
    assert Counter(map(key, written.collect())) == Counter(map(key, found))
