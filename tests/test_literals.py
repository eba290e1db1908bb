"""Required literals: derived clauses, folding as Java matches, and equal rows with and without them."""

import pytest
from pyspark.sql import functions as F

from gatewarden.functions.literals import FLAGS, FOLDED, clauses, fold, matches, may_match
from gatewarden.functions.patterns import KEYWORDS, SCANNING
from gatewarden.functions.text import url_decode_text
from gatewarden.operators import detect, keyword

PATTERNS = [p for group in KEYWORDS.values() for p, _ in group] + [p for p, _ in SCANNING]


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"\bdrop\s+(table|database)\b", (("database", "table"), ("drop",))),
        (r"(\bor\b|\band\b)\s+\d+\s*=\s*\d+", (("and", "or"), ("=",))),
        (r"on\w+\s*=\s*['\"]", (("on",), ("=",), ('"', "'"))),
        (r"\/uploads?\/?", (("/upload",),)),
        (r"a{0,3}b", (("b",),)),
        (r"(?:x|)y", (("y",),)),  # an empty way requires nothing
        (r"(?!foo)bar", (("bar",),)),
        (r"x(?=y)z", (("x",), ("z",))),
        (r"(ab)?", ()),
        (r"[a-z&&b]c", ()),  # Java alone reads these
        (r"\p{L}x", ()),
        (r"[a[b]]c", ()),
        ("é1É", (("1",),)),  # only ASCII letters are folded
    ],
)
def test_clauses(pattern, want):
    assert clauses(pattern) == want


def test_every_pattern_has_literals():
    assert all(clauses(p) for p in PATTERNS)


def test_fold_knows_all_characters_java_takes_for_letters(spark):
    """Every character of the basic plane against every letter: what matches without regard to case folds to it."""
    chars = spark.range(128, 0xD800).unionByName(spark.range(0xE000, 0x10000)).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    hits = chars.where(F.col("c").rlike(FLAGS + "^[a-z]$")).select("c", fold(F.col("c")).alias("to")).collect()
    assert {r.c: r.to for r in hits} == FOLDED


def test_same_decision_as_the_pattern_alone(spark):
    made = [
        "GET /?q=1 UNİON all ſelect 1 HTTP/1.1", "GET /%75nion%20select HTTP/1.1", "x OR 1 = 1", "band 1=1", "and 12=12", "<SCRIPT src=x>", "<script", "onload = 'x'", "on=", "KMD /c", "wget\thttp", "WGET",
        "/ADMIN", "/admin/", "/admin?x", "a.sh", "a.sh\n", "..\\", "/../%", "Nıkto", "dirbuster", "", "İ" * 50 + "sqlmap", "select " + "x" * 20000 + " from t", "drop view", "exec (", "powershell", "İ",
    ]
    rows = spark.createDataFrame([(t,) for t in made] + [(None,)], "text string").select("text", fold(F.col("text")).alias("folded"))
    text, folded = F.col("text"), F.col("folded")
    got = rows.select("text", *(F.struct(text.rlike(FLAGS + p).alias("want"), matches(text, folded, p).alias("got"), may_match(folded, p).alias("may")).alias(f"p{k}") for k, p in enumerate(PATTERNS))).collect()
    hit = set()
    for r in got:
        for k, p in enumerate(PATTERNS):
            x = r[f"p{k}"]
            assert bool(x.want) == bool(x.got) and (x.may or not x.want), (r.text, p)
            if x.want:
                hit.add(p)
    assert len(hit) > 12 and any(not r[f"p{k}"].may for r in got for k in range(len(PATTERNS)) if r.text)


def test_findings_equal_those_without_the_index(spark):
    """Raw and encoded attacks, nulls, empty and long fields, and a pattern that only the decoded text holds."""
    attack = ["GET /?a=union%20select HTTP/1.1", "GET /<script>alert(1)</script> HTTP/1.1", "GET /index HTTP/1.1", "GET /..%2f.. HTTP/1.1", "GET /x%27%20or%201=1 HTTP/1.1", "", None, "GET /" + "a" * 50000 + "%20wget%20x HTTP/1.1"]
    agents = ["Mozilla", "sqlmap/1.0", "Nikto", "", None, "curl 7", "DirBuster%20", "bash -c id; nc -l"]
    rows = [(f"10.0.0.{k % 5}", "f", k, a, u, r) for k, (a, u, r) in enumerate((a, u, r) for a in attack for u in agents for r in ("-", None, "http://x/?q=drop%20table%20t", "http://x/admin/"))]
    entries = spark.createDataFrame(rows, "ip string, file_path string, line_number long, request_line string, user_agent string, referer string").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "200 AS status", "1L AS bytes_sent")
    targets = keyword.unpivot_targets(entries).withColumn("decoded", url_decode_text(F.col("text"))).select("line_number", "field", "decoded")
    want = set()
    for group, patterns in KEYWORDS.items():
        first = F.coalesce(*(F.when(F.col("decoded").rlike(FLAGS + p), F.lit(p)) for p, _ in patterns))
        want |= {(r.line_number, r.field, group, r.p) for r in targets.select("line_number", "field", first.alias("p")).where("p IS NOT NULL").collect()}
    got = [(r.line_number, r.field, r.pattern_type, r.pattern) for r in keyword.keyword_findings(entries).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    raw = keyword.unpivot_targets(entries)
    pairs = {(r.ip, r.line_number, p) for p, _ in SCANNING for r in raw.where(F.col("text").rlike(FLAGS + p)).select("ip", "line_number").distinct().collect()}
    tools = {r.ip: (r.matches, tuple(r.patterns)) for r in detect.scanning_tool_signature(entries).collect()}
    assert tools == {ip: (sum(x[0] == ip for x in pairs), tuple(sorted({x[2] for x in pairs if x[0] == ip}))) for ip in {x[0] for x in pairs}}


def test_empty_table(spark):
    entries = spark.createDataFrame([], "ip string, file_path string, line_number long, ts timestamp_ntz, request_line string, user_agent string, referer string, status int, bytes_sent long")
    assert keyword.keyword_findings(entries).count() == 0 and detect.scanning_tool_signature(entries).count() == 0
    assert {(r.texts, r.picked, r.matched) for r in keyword.pattern_selectivity(entries).collect()} == {(0, 0, 0)}
