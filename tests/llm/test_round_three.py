"""Mixing, conversation repair and fill-in-middle against plain Python and SQL, with the odd cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gatewarden.llm import infill, mixing, repair

SF = "/root/testdata/sf0.001"


def by_sql(table, sql, folder=SF):
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = c.sql(sql)
    return found.columns, sorted(found.fetchall(), key=str)


# -- mixing ---------------------------------------------------------------------------------------------


def test_mixing_matches_sql(spark):
    columns, want = by_sql("documents", mixing.SQL)
    assert sorted(map(tuple, mixing.op11_mixing(spark, SF).select(*columns).collect()), key=str) == want


DOCS = "doc_id long, text string, source string, weight double, target string, size string, rest long, _at long"


def odd_documents(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), "big") for k in range(300)]
    rows += [(1000 + k, f"x{k}\t y\x0b z ", "mid") for k in range(20)]
    rows += [(2000, "one", "small"), (2001, None, "none"), (2002, "", "none"), (2003, " \n", None), (2004, "q " * 5000, None)]
    rows += [(3000, "a b c", "same")] * 50 + [(None, f"n{k} m", "same") for k in range(20)]
    return spark.createDataFrame([(*r, 1.0, "t", "s", 7, 3) for r in rows], DOCS)


def plain_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, goal = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in goal]
        left = total - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return goal | share
        goal |= {s: most * sizes[s] for s in over}


def test_mixing_edges(spark):
    docs = odd_documents(spark)
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    words = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == words
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    goal = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.5 + 1e-6, s
    key = lambda r: tuple(map(str, r))
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mixed(docs.where("false")).count() == 0
    assert mixing.mixed(docs.where("text is null")).select("taken", "target").first() == (0, 0.0)


def test_mixing_budgets_are_nested_and_many_sources_are_salted(spark, monkeypatch):
    docs = odd_documents(spark).where("source = 'big'")
    rows = mixing.sized(docs)
    size = rows.agg(F.sum("size")).first()[0]
    whole = None
    for rest in (size // 7, size // 3, size - 1):
        ends = mixing.boundaries(rows, spark.createDataFrame([("big", rest)], "source string, rest long"), True).first()
        at = (ends.at_k1, ends.at_k2, ends.at_k3)
        under = {r.doc_id: r["size"] for r in rows.collect() if (r.k1, r.k2, r.k3) < at}
        assert sum(under.values()) + ends.rest == rest and ends.rest > 0
        assert whole is None or whole <= under.keys()
        whole = under.keys()
    few = sorted(map(str, mixing.mixed(odd_documents(spark)).collect()))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(str, mixing.mixed(odd_documents(spark)).collect())) == few


# -- conversation repair --------------------------------------------------------------------------------

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, edits, texts) by shortest paths over (row, state), whole edit strings beside the costs."""
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = (cost, edits, out)
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT:
                heapq.heappush(heap, (cost + 5, edits + "I", i, NEXT[state, role[0]], (*out, role + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        if (state, role[:1]) in NEXT:
            heapq.heappush(heap, (cost + more, edits + "K", i + 1, NEXT[state, role[:1]], (*out, f"{role}:{text}")))
        for to in ("user", "assistant"):
            if (state, to[0]) in NEXT:
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, NEXT[state, to[0]], (*out, f"{to}:{text}")))
    return min(done[len(rows), s] for s in ("", "a") if (len(rows), s) in done)


def code(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_repair(rows, damage=True):
    """conv_id -> the result's columns, row by row."""
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = conversations[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        v = zlib.crc32(f"{conv if conv is not None else ' '}:{turn if turn is not None else ' '}".encode()) % 20 if damage else 19
        if v == 1:
            text = ""
        if v == 2:
            text = re.sub("[.!?]", "", text)
        if v == 4:
            role = "user"
        kept.extend([(turn, role, text)] * (0 if v == 0 else 2 if v == 3 else 1))
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], code(*r[1:])))
        seen, judged = set(), []
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in kept if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:], strict=False)]
        cost, edits, texts = cheapest(judged)
        faults = Counter(f for _, _, f in judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r.conv_id: tuple(r[c] for c in RESULT) for r in df.collect()}


def odd_conversations(spark):
    rng = random.Random(4)
    texts = ["Good.", "Good.", "no end", "", " \t", None, "Fine?", "été!\n", "x" * 20000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randrange(1, 12))]
    rows += [(70, None, "user", "a."), (70, None, "user", "a."), (70, None, None, None), (71, 5, "user", "b."), (71, 9, "assistant", "c."), (71, 9, "assistant", "c."), (71, 9, "assistant", "a.")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("code", F.lit("z")).withColumn("kind", F.lit(9))


def test_repair_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(repair.op12_conversation_repair(spark, SF)) == plain_repair(map(tuple, rows))


@pytest.mark.parametrize("damage", [True, False])
def test_repair_edges(spark, damage):
    rows, df = odd_conversations(spark)
    prepared = (repair.damaged if damage else repair.undamaged)(df)
    got = repair.edits(prepared)
    want = plain_repair(rows, damage)
    assert found(got) == want
    turns = defaultdict(list)
    for r in repair.repaired_turns(prepared, got).collect():
        turns[r.conv_id].append((r.place, r.role, r.text))
    for conv, result in want.items():
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in sorted(turns[conv])).encode()).hexdigest() == result[-1]
    assert repair.edits(repair.damaged(df.where("false"))).count() == 0


def test_repair_of_dropped_rows(spark):
    rows = [(c, t, "user", "a.") for c in range(400) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = found(repair.edits(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert rows and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_survivors_equal_shortest_paths():
    rng = random.Random(3)
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "u2"]), f"t{k}", rng.choices([None, "blank", "duplicate", "truncated"], [rng.random() + 0.1, 0.3, 0.2, 0.3 * rng.random()])[0]) for k in range(rng.randrange(14))]
        s = repair.Survivors()
        for role, text, fault in rows:
            if fault in ("blank", "duplicate"):
                s.deleted(1)
            else:
                s.row(role, text, fault)
        cost, edits, texts = cheapest(rows)
        assert s.end() == (cost, edits, hashlib.sha256("\n".join(texts).encode()).hexdigest()), rows


def test_survivors_stay_few():
    for roles in (["tool"], ["user"], ["tool", "user"], ["assistant", "user", "tool"], ["system"]):
        s = repair.Survivors()
        rng = random.Random(1)
        for k in range(3000):
            s.row(rng.choice(roles), f"t{k}.", None)
        assert s.most_nodes < 12
    s = repair.Survivors()
    s.row("user", "x.", None)
    s.deleted(10**6)
    cost, edits, _ = s.end()
    assert (cost, len(edits)) == (2 * 10**6 + 2, 10**6 + 1) and s.most_nodes < 12
    t = repair.Survivors()  # an alternating conversation is settled as it comes
    for k in range(3000):
        t.row("user" if k % 2 == 0 else "assistant", "x.", None)
    assert sum(map(len, t.settled)) > 2900


# -- fill in middle -------------------------------------------------------------------------------------


def test_infill_matches_sql(spark):
    columns, want = by_sql("documents", infill.SQL)
    assert sorted(map(tuple, infill.op13_fill_in_middle(spark, SF).select(*columns).collect()), key=str) == want


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    p, q = sorted(v % (len(units) + 1) for v in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_edges(spark):
    rng = random.Random(6)
    signs = ["word", "B", " ", "\n", "é", "日", "\U0001f600", "<", ">", "S", "<P", "M>", "\x00", "12"]
    texts = [None, "", "a", "<", "<S", ">", "a<P>b", "x" * 300000, "日" * 200000, "ab " * 200000, *("".join(rng.choice(signs) for _ in range(n)) for n in (1, 3, 63, 64, 65, 500, 4096, 70000) for _ in range(6))]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "a b", 1, "x"), (3, "repeated one", 1, "x"), (3, "repeated one", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string")
    key = lambda r: str((r[0], hashlib.sha256(str(r[1:]).encode()).hexdigest()))
    got = infill.with_infill(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    want = [(r[0], *plain_infill(r[0], r[1])) for r in rows]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    whole = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.restored_sha256) for r in infill.digests(infill.with_infill(docs)).collect()) == whole
    assert infill.with_infill(docs.where("false")).count() == 0


def test_skip_list_reaches_every_rank(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 37)
    monkeypatch.setattr(infill, "STEP", 4)
    rng = random.Random(8)
    for n in (0, 1, 5, 40, 700):
        text = "".join(rng.choice(["ab", "c", " ", "é", "日", "long" * 30]) for _ in range(n))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        found_ = infill.UnitList(text.encode())
        assert (found_.n, found_.points) == (len(units), len(text)) and (n < 700 or len(found_.lanes) > 2)
        for rank in range(len(units) + 1):
            before = "".join(units[:rank])
            assert found_.seek(rank) == (len(before), len(before.encode()))
