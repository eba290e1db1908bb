"""The stages of the pipeline over sf0.001."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != "packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= before
            before = docs.count()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} and docs.where("length > 4096").count() == 0


def test_one_row_of_each_group(spark):
    import random

    from pyspark.sql import functions as F

    from gatewarden.llm import jaccard, stages

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(4)]
    near = texts[0].split()
    near[100] = "changed"
    rows = [(2, texts[0]), (1, " ".join(near)), (None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[3]), (9, ""), (None, None), (4, "short")]
    docs = spark.createDataFrame([(k, x, "en" if n != 4 else "de") for n, (k, x) in enumerate(rows)], "doc_id long, text string, lang string")
    group = {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "c", 6: "d", 7: "d"}
    want: dict = {}
    for n, (k, x) in enumerate(rows):
        g = group.get(n, n)
        want[g] = min(want.get(g, (True, 0, "")), (k is None, k or 0, x or "")) if g in want else (k is None, k or 0, x or "")
    got = stages.keep_one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == sorted(want.values())
    # on the given table each class of near duplicates keeps one row
    given = spark.read.parquet(f"{SF}/documents.parquet")
    given = given.unionByName(given.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    classes = jaccard.near_classes(given.withColumn("key", F.xxhash64(*given.columns)), id_col="key").select("component_id").distinct().count()
    assert stages.keep_one_of_each_group(spark, given, SF).count() == classes


OWN = ["quality_score", "spans", "base", "items", "hit_words", "n_words", "kept", "row", "d", "_cands"]


def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, shared and missing ids, and columns named like what stages use."""
    from pyspark.sql import functions as F

    given = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    texts = [None, "", " \n", *given, "Before. " + bench[0].upper() + " after!", "x " + bench[1] + " y " + bench[2], "one " * 40_000, "é€😀 a.b@c.de, +49 30 1234567, 4111-1111-1111-1111; +4111 1111 1111 1111 1.2.3.4 1.2.3.400"]
    rows = [(None if k % 7 == 3 else k // 2 if k % 5 == 4 else k, t, 0 if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[5], rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return rows, df.select("*", *(F.lit(f"own {c}").alias(c) for c in OWN))


def own_columns(docs, got):
    rows = got.collect()
    assert got.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in OWN)
    return sorted((repr(r.doc_id), repr(r.text), r.n_chars) for r in rows)


def test_empty_tables(spark):
    _, docs = odd_docs(spark)
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs.where("false"), SF)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def test_quality_by_plain_convolution(spark):
    import numpy as np

    from gatewarden.llm import quality, stages

    net = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        data = (text or "").encode()
        feats = []
        for at in range(0, max(1, len(data) - 512 + 448), 448):
            chunk = data[at : at + 512].ljust(512, b"\0")
            best = np.full(16, -np.inf)
            for p in range(0, 505, 4):
                best = np.maximum(best, np.concatenate([net.emb[b] for b in chunk[p : p + 8]]) @ net.filt)
            feats.append(np.maximum(best + net.bias, 0))
        return 1 / (1 + np.exp(-(np.mean(feats, axis=0) @ net.out + net.out_bias)))

    rows, docs = odd_docs(spark)
    scores = {t: score(t) for _, t, _ in rows}
    assert all(abs(s - 0.5) > 1e-3 for s in scores.values())
    want = sorted((repr(k), repr(t), n) for k, t, n in rows if scores[t] >= 0.5)
    assert own_columns(docs, stages.keep_good(spark, docs, SF)) == want and 0 < len(want) < len(rows)


def test_quality_training_goes_down():
    import numpy as np

    from gatewarden.llm import quality

    texts = ["good words here " * 30, "bad!! noise " * 50, "plain text " * 5]
    labels = np.array([1, 0, 1], np.float32)

    def loss(net):
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        p = quality.score_rows(net, np.frombuffer(b"".join(data), np.uint8), offsets)
        w = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        return float(-(w * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / 3)

    first, after = quality.train(texts, labels, epochs=0), quality.train(texts, labels, epochs=30, rate=0.003)
    assert loss(after) < 0.5 * loss(first)


def test_decontamination_by_loops(spark):
    import re

    from gatewarden.llm import stages

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: list(re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower)))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [m[0] for m in words(r.text)]
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()

    def cut(t):
        found = words(t)
        w, hit = [m[0] for m in found], [False] * len(found)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit[k : k + size] = [True] * size
        out, at, k = "", 0, 0
        while k < len(w):
            if hit[k]:
                out += t[at : found[k].start()]
                while k < len(w) and hit[k]:
                    at, k = found[k].end(), k + 1
            else:
                k += 1
        return out + t[at:] if t else t

    rows, docs = odd_docs(spark)
    want = sorted((repr(k), repr(cut(t)), n if t is None else len(cut(t))) for k, t, n in rows)
    assert own_columns(docs, stages.remove_benchmark_passages(spark, docs, SF)) == want
    assert sum(len(cut(t) or "") < len(t or "") for _, t, _ in rows) >= 2


def test_masking_by_loops(spark):
    from test_operators import base_spans

    from gatewarden.llm import pii, stages

    def mask(t):
        out, at = "", 0
        for start, kind, end in base_spans(t):
            if start >= at:
                out += t[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        return out + t[at:] if t else t

    rows, docs = odd_docs(spark)
    want = sorted((repr(k), repr(mask(t)), n if t is None else len(mask(t))) for k, t, n in rows)
    assert own_columns(docs, stages.mask_personal_data(spark, docs, SF)) == want


def test_packing_holds_every_id_once(spark):
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from gatewarden.llm import packing, stages

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows, docs = odd_docs(spark)
    got = stages.pack(spark, docs, SF).collect()
    want = Counter()
    for k, t, _ in rows:
        want[k, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    # pieces of one document follow each other by start; documents that share an id and a length are told apart by order
    pieces: dict = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(r)
    lengths: dict = {}
    for r in got:
        assert zlib.crc32(np.frombuffer(r.ids, np.uint16).astype("<u4").tobytes()) == r.ids_crc32 and len(r.ids) == 2 * r.length
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 4096 and sum(lengths.values()) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for q in lengths:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == q), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    whole = Counter()
    for r in got:
        if r.start == 0 and r.length == r.doc_tokens:
            whole[r.doc_id, r.ids_crc32] += 1
    assert whole <= want and len(whole) >= len(want) - 6
