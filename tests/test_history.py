"""Histories of answers and two-phase publishing, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from gatewarden.operators import history as h
from gatewarden.sources import publish as p

BASE = datetime(2024, 1, 1)
COLUMNS = "ip string, provider string, query_ts timestamp_ntz, confidence_score int, country_code string"


def answers(rng, n):
    return [(rng.choice(["hot"] * 4 + ["a", "b", "c"]), rng.choice("xy"), BASE + timedelta(seconds=rng.randrange(4000)), rng.randrange(5), rng.choice(["DE", "FR", None])) for _ in range(n)]


def plain(rows):
    best = {}
    for ip, provider, t, score, country in rows:
        key = (score, country is not None, country or "")
        best[ip, provider, t] = max(best.get((ip, provider, t), key), key)
    out, times = set(), {}
    for ip, provider, t in best:
        times.setdefault((ip, provider), []).append(t)
    for (ip, provider), ts in times.items():
        ts.sort()
        out |= {(ip, provider, t, end, best[ip, provider, t][0], best[ip, provider, t][2] or None) for t, end in zip(ts, ts[1:] + [None])}
    return out


def shown(df):
    rows = [tuple(r) for r in df.select("ip", "provider", "valid_from", "valid_to", "confidence_score", "country_code").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_updates_equal_one_history_of_all(spark, tmp_path):
    rng = random.Random(5)
    batches = [answers(rng, 300), answers(rng, 40), [(r[0], *r[1:]) for r in answers(rng, 30) if r[0] == "a"], []]
    seen, files = [], []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows + [(None, "x", BASE, 1, "DE"), ("a", "x", None, 1, "DE")], COLUMNS)
        h.update_history(spark, str(tmp_path), df, f"run-{k}", buckets=8)
        seen += rows
        assert shown(h.read_history(spark, str(tmp_path))) == plain(seen)
        files.append(p.manifests(spark, str(tmp_path))[-1].parts)
    assert len(files[2]) == 1 and files[3] == []  # one address: one bucket written; no answers: none
    h.update_history(spark, str(tmp_path), spark.createDataFrame(batches[0], COLUMNS), "run-1", buckets=8)
    assert shown(h.read_history(spark, str(tmp_path))) == plain(seen)
    at = BASE + timedelta(seconds=2000)
    assert shown(h.valid_at(h.read_history(spark, str(tmp_path)), at)) == {r for r in plain(seen) if r[2] <= at and (r[3] is None or r[3] > at)}


@pytest.mark.parametrize("limit", [0, h.SMALL])
def test_values_at_times(spark, limit):
    rng = random.Random(7)
    rows = [r for r in answers(rng, 200) if r[1] == "x"]
    asked = [(rng.choice(["hot", "hot", "a", "b", "none"]), BASE + timedelta(seconds=rng.randrange(-50, 5000)), k) for k in range(400)] + [(None, BASE, -1), ("a", None, -2)]
    asked += [(r[0], r[2], 1000 + k) for k, r in enumerate(rows)]
    want = {}
    for ip, _, t, end, _, country in plain(rows):
        want |= {k: country for a, s, k in asked if a == ip and s is not None and country and t <= s and (end is None or s < end)}
    entries = spark.createDataFrame(asked, "ip string, ts timestamp_ntz, k int")
    got = h.attach_valid(entries, h.history(spark.createDataFrame(rows, COLUMNS)), limit=limit).collect()
    assert len(got) == len(want) and {r.k: r.country for r in got} == want


def test_no_answers(spark):
    empty = spark.createDataFrame([], COLUMNS)
    entries = spark.createDataFrame([("a", BASE, 1)], "ip string, ts timestamp_ntz, k int")
    assert h.history(empty).count() == 0 and h.attach_valid(entries, h.history(empty)).count() == 0


def test_a_run_that_fails_shows_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert p.published(spark, root) is None
    df = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, text string")
    assert p.publish(df(1, 2), root, "one")
    with monkeypatch.context() as m:
        m.setattr(p, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed between the phases")))
        with pytest.raises(RuntimeError):
            p.publish(df(3, 4, 5), root, "two")
    assert {r.id for r in p.published(spark, root).collect()} == {1, 2}
    assert p.publish(df(3, 4), root, "two")  # again, whatever the failed run left
    assert not p.publish(df(9), root, "two")
    assert p.publish(df(), root, "none")
    assert sorted(r.id for r in p.published(spark, root).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        p.publish(df(1), root, "../up")


def test_a_run_whose_job_fails(spark, tmp_path):
    root = str(tmp_path)
    bad = spark.range(10).selectExpr("id", "CASE WHEN id = 7 THEN raise_error('lost') ELSE 'x' END AS text")
    with pytest.raises(Exception, match="lost"):
        p.publish(bad, root, "run")
    assert p.published(spark, root) is None
    assert p.publish(spark.range(10).selectExpr("id", "'x' AS text"), root, "run") and p.published(spark, root).count() == 10
