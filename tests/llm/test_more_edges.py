"""Cases that the tests of the operators leave out: empty tables, clashing names, megabyte texts, another kind of table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import audio, decontam, infill, jaccard, mixing, packing, pii, repair, repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("n", "ids", "rid", "chunk", "head", "pieces", "size", "start", "length", "offset", "part", "items", "spans", "code", "range", "component_id", "n_words", "k1", "rest", "media", "audio", "output", "form", "at", "x", "unit")


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, " ".join(words(1, 80)), "en", "s", 1), (2, " ".join(words(1, 80)), None, "s", 1), (3, None, "en", None, 1), (4, "", "en", "s", 1), (None, "a b c", "en", "t", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_audio_of_an_empty_table(docs):
    assert audio.read(audio.stored(docs.where("false"))).count() == 0


def test_benchmark_without_items(spark, docs):
    for bench in (spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, None), (2, " .")], "item_id long, text string")):
        got = decontam.contamination(docs, bench)
        assert got.count() == docs.count() and not any(r.hit_words or r["items"] for r in got.collect())
        assert sorted((r.text or "") for r in decontam.without_hits(got).collect()) == sorted((r.text or "") for r in docs.collect())
    assert decontam.contamination(docs.where("false"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize(
    "operator",
    [packing.packed, jaccard.near_classes, repeats.repeated_spans, mixing.mixed, lambda d: infill.digests(infill.with_infill(d)), lambda d: audio.read(audio.stored(d)).select("doc_id", "audio"), lambda d: pii.with_spans(d, pii.train(d)).select("doc_id", "text", F.col("spans").cast("string"))],
    ids=["packing", "jaccard", "repeats", "mixing", "infill", "audio", "pii"],
)
def test_clashing_names_change_nothing(docs, operator):
    plain, more = operator(docs), operator(docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}))
    mine = [c for c in plain.columns if c != "sequence_id"]
    rows = lambda df: sorted(map(str, df.select(*mine).collect()))
    assert rows(more) == rows(plain) and len(rows(plain)) >= docs.count()


def test_clashing_names_in_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (None, None, None, None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain.withColumns({c: F.lit("own") for c in (*CLASHING, "kind", "place", "audit", "cost")})
    for damage in (repair.damaged, repair.undamaged):
        assert sorted(map(str, repair.edits(damage(more)).collect())) == sorted(map(str, repair.edits(damage(plain)).collect()))


def test_repeats_in_texts_of_megabytes(spark):
    """A passage of 700,000 bytes in the middle of a text of 2 MB that a smaller document holds in 1.4 MB."""
    first = " ".join(words(7, 140_000))
    passage = "<" + first[300_000:1_000_000].replace("é", "e") + ">"
    second = "#".join(words(8, 70_000)) + passage + "#".join(words(9, 70_000))
    got = {r.doc_id: r for r in repeats.repeated_spans(spark.createDataFrame([(1, first), (2, second), (3, "short")], "doc_id long, text string")).collect()}
    assert not got[1].spans and not got[3].spans
    (span,) = got[2].spans
    assert span.end - span.start == 700_000 and second[span.start : span.end] == first[300_000:1_000_000]
    assert got[2].kept_sha256 == hashlib.sha256((second[: span.start] + second[span.end :]).encode()).hexdigest()


def test_near_copies_of_megabytes(spark):
    """150,000 words, a copy with 30 of them changed, one of which half is another text, and a short text in between."""
    one = words(11, 150_000)
    near, half = list(one), one[:75_000] + words(12, 75_000)
    for k in range(0, 150_000, 5_000):
        near[k] = "changed"
    rows = [(5, " ".join(one)), (6, "a few words of a short text"), (7, " ".join(near)), (8, " ".join(half))]
    got = {r.doc_id: r for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.component_id for k, r in got.items()} == {5: 5, 6: 6, 7: 5, 8: 8} and got[5].n_shingles == 150_000 - 4


def test_vbri_table():
    """A stream whose first frame holds a VBRI table: its counts are read, its frame is no audio."""
    payload = audio.padded(b"spoken" * 300)
    whole = audio.write(payload)
    frames = whole[audio.parse(whole).offsets[0] :]
    n = len(payload) // audio.UNIT
    table = b"VBRI" + bytes(6) + len(frames).to_bytes(4, "big") + n.to_bytes(4, "big")
    got = audio.parse(audio._frame(13, bytes(36 - 15) + table) + frames)
    assert (got.variable, got.declared_frames, got.declared_bytes) == ("VBRI", n, len(frames))
    assert got.frames == n and got.payload == payload and got.bad_checksums == got.skipped == 0
