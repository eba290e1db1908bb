"""Language identification of mixed-language text.

Each word's script, by code point range, narrows the candidate languages; letter trigrams score the word under
each candidate; Viterbi over the words, with a penalty for a switch, labels spans. A text's language is that
of most labelled bytes, its score their share. The spans themselves are in lang_spans: runs of words of one
language, first byte and end in the text in lower case (as long as the text, but for a few letters).

Trigrams are counted over all training rows into BUCKETS hashed counters a language (the bound of the model's
size); words are runs of letters a-z and of bytes from 0x80 on, in lower case.

Defined results: null texts and texts without a letter are `und` with score 0; with no training rows all are;
ties go to the language first in the alphabet; repeated rows are labelled alike; extra columns stay, and those
named like a result are replaced; an empty table gives an empty table. Labels are 16-bit, for up to 32,767 languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, plus, released, table, utf8, word_spans

BUCKETS, PENALTY, PIECE, BLOCK = 1 << 15, 6.0, 256, 2 << 20
#: Share of a language's words that must be in a script for the script to allow it.
SCRIPT_SHARE = 0.005
# First code points of script ranges (Unicode blocks, joined), names in SCRIPTS.
STARTS = np.array([0x0000, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0780, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00])
SCRIPTS = ["latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han", "other"]
NAMES = sorted(set(SCRIPTS))
_SCRIPT_OF = np.array([NAMES.index(s) for s in SCRIPTS])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages


def lowered(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(arr))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram buckets, first trigram of each word, starts, ends, first word of each row, script of each word)."""
    starts, ends, first = word_spans(data, offsets, _LETTER)
    sizes = ends - starts
    n = sizes  # a word of k bytes, with a mark at each side, has k trigrams
    at = np.concatenate([[0], np.cumsum(n)])
    inner = np.arange(int(at[-1])) - np.repeat(at[:-1], n)
    pos = np.repeat(starts, n) + inner
    big = np.concatenate([data, [0]]).astype(np.uint32)
    left = np.where(inner == 0, 1, big[pos - 1])
    right = np.where(inner == np.repeat(n, n) - 1, 2, big[np.minimum(pos + 1, len(data))])
    code = (left << 16 | big[pos] << 8 | right).astype(np.uint64)
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int32)
    point = np.where(big[pos] < 0x80, 0, 0).astype(np.int64)
    b0, b1, b2 = big[pos].astype(np.int64), big[np.minimum(pos + 1, len(data))].astype(np.int64), big[np.minimum(pos + 2, len(data))].astype(np.int64)
    point = np.where((b0 >= 0xC0) & (b0 < 0xE0), (b0 & 31) << 6 | (b1 & 63), point)
    point = np.where((b0 >= 0xE0) & (b0 < 0xF0), (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63), point)
    point = np.where(b0 >= 0xF0, 0x10FFFF, point)
    top = np.maximum.reduceat(point, at[:-1]) if len(starts) else np.zeros(0, np.int64)
    return bucket, at, starts, ends, first, _SCRIPT_OF[np.searchsorted(STARTS, top, side="right") - 1]


def train(rows: DataFrame) -> Model:
    """A model from all rows (lang, text): trigram and script counts, added up where the rows are."""

    def count(batches):
        sums: dict = {}
        for b in batches:
            data, offsets = lowered(b.column("text"))
            langs = b.column("lang").to_pylist()
            for x, y in blocks(offsets, BLOCK):
                bucket, at, _, _, first, script = features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                names, own = np.unique(np.array(langs[x:y]), return_inverse=True)
                words = np.repeat(own, np.diff(first))
                both = np.bincount(np.repeat(words, np.diff(at)).astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                scripts = np.bincount(words * len(NAMES) + script, minlength=len(names) * len(NAMES)).reshape(-1, len(NAMES))
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + np.concatenate([both[k], scripts[k]])
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "slot", "n"])

    got = rows.select("lang", "text").mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table_ = np.zeros((len(langs), BUCKETS + len(NAMES)))
    table_[np.searchsorted(langs, got["lang"].to_numpy(str)) if len(langs) else [], got["slot"]] = got["n"]
    grams, scripts = table_[:, :BUCKETS] + 0.5, table_[:, BUCKETS:]
    scores = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))).T
    allowed[~allowed.any(1)] = True
    return Model(langs, np.ascontiguousarray(scores), allowed)


def label_words(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: Viterbi per row, with pieces of PIECE words worked on side by side.

    A piece's best scores from every language before it to every language at its end are taken for all pieces
    at once; a row's pieces are then joined in order, and each is traced back from its known end.
    """
    n_words, n_lang = score.shape
    out = np.zeros(n_words, np.int16)
    if not n_words:
        return out
    per_row = np.diff(first)
    counts = -(-per_row // PIECE)
    row = np.repeat(np.arange(len(per_row)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = first[row] + nth * PIECE
    size = np.minimum(PIECE, first[row + 1] - start)
    order = np.argsort(-size, kind="stable")  # long pieces first: at each step the open ones are a prefix
    start, size, row, nth = start[order], size[order], row[order], nth[order]
    n = len(start)
    best = -penalty * (1 - np.eye(n_lang, dtype=np.float32))[None] + score[start][:, None, :]
    best = best.astype(np.float32)
    open_ = np.searchsorted(-size, -np.arange(1, PIECE + 1), side="right")
    for t in range(1, int(size[0])):
        m = open_[t]
        b = best[:m]
        best[:m] = np.maximum(b, b.max(2, keepdims=True) - penalty) + score[start[:m] + t][:, None, :]
    entry = np.zeros((n, n_lang), np.float32)
    before = np.zeros((n, n_lang), np.int16)
    by_row = np.full((len(per_row), int(counts.max())), -1)
    by_row[row, nth] = np.arange(n)
    last = np.zeros((len(per_row), n_lang), np.float32)
    for k in range(by_row.shape[1]):
        p = by_row[:, k]
        rows = np.flatnonzero(p >= 0)
        p = p[rows]
        entry[p] = last[rows]
        joined = last[rows][:, :, None] + best[p]
        before[p] = joined.argmax(1)
        last[rows] = joined.max(1)
    end = np.zeros(n, np.int16)
    state = last.argmax(1).astype(np.int16)
    for k in reversed(range(by_row.shape[1])):
        p = by_row[:, k]
        rows = np.flatnonzero(p >= 0)
        p = p[rows]
        end[p] = state[rows]
        state[rows] = before[p, state[rows]]
    came = np.zeros((PIECE, n, n_lang), np.int16)
    value = np.maximum(entry, entry.max(1, keepdims=True) - penalty) + score[start]
    own = np.arange(n_lang, dtype=np.int16)
    for t in range(1, int(size[0])):
        m = open_[t]
        v = value[:m]
        top = v.argmax(1).astype(np.int16)
        high = v.max(1, keepdims=True) - penalty
        came[t, :m] = np.where(v >= high, own, top[:, None])
        value[:m] = np.maximum(v, high) + score[start[:m] + t]
    now = end.copy()
    for t in reversed(range(int(size[0]))):
        m = open_[t] if t else n
        out[start[:m] + t] = now[:m]
        if t:
            now[:m] = came[t, np.arange(m), now[:m]]
    return out


def predict(model: Model, arr: pa.Array) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    data, offsets = lowered(arr)
    has = pc.fill_null(pc.match_substring_regex(arr.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    langs, shares, spans = ["und"] * len(arr), np.zeros(len(arr)), [[] for _ in range(len(arr))]
    if not model.langs:
        return langs, shares, spans
    for x, y in blocks(offsets, BLOCK):
        bucket, at, starts, ends, first, script = features(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
        if not len(starts):
            continue
        score = np.add.reduceat(model.scores[bucket], at[:-1], axis=0)
        score = np.where(model.allowed[script], score, score.min(1, keepdims=True) - 4)
        label = label_words(score, first)
        doc = np.repeat(np.arange(y - x), np.diff(first))
        weight = np.bincount(doc * len(model.langs) + label, weights=ends - starts, minlength=(y - x) * len(model.langs)).reshape(y - x, -1)
        top = weight.argmax(1)
        for k in np.flatnonzero(has[x:y] & (weight.sum(1) > 0)):
            langs[x + k], shares[x + k] = model.langs[top[k]], weight[k, top[k]] / weight[k].sum()
        new = np.ones(len(label), bool)
        new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(label)) - 1
        base = offsets[x : y + 1] - offsets[x]
        for k, s, e, g in zip(doc[at].tolist(), (starts[at] - base[doc[at]]).tolist(), (ends[last] - base[doc[at]]).tolist(), label[at].tolist(), strict=True):
            if has[x + k]:
                spans[x + k].append({"start": s, "end": e, "lang": model.langs[g]})
    return langs, shares, spans


def with_language(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents with lang_pred, score and lang_spans."""
    base = documents.drop("lang_pred", "score", "lang_spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    known = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, shares, spans = predict(known.value, b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind)], names=[*b.schema.names, "lang_pred", "score", "lang_spans"])

    return base.mapInArrow(released(run), plus(base, lang_pred="string", score="double", lang_spans="array<struct<start: long, end: long, lang: string>>"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs.where((part != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    marked = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return with_language(marked, model).drop("text")
