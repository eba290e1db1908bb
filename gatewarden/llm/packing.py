"""Packing of tokenised documents into sequences of at most 4096 tokens, with combinations from non-negative
least squares.

A document's tokens fill whole sequences first; what remains (under one sequence) is counted in a histogram of
STEP tokens a bin. All combinations of up to DEPTH bins that fill a window are enumerated, their repeat counts
are solved against the histogram by non-negative least squares and rounded down, and documents take the slots
by their rank in the bin. What no combination takes is packed greedily: laid end to end and cut at the window.

Histogram, combinations and plan have a fixed size (bins and DEPTH); ranks and running totals are taken in
ranges of rows whose sums are added up first, so no bin and no total is gathered in one task.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each; a null doc_id is
kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, released, saved, table

WINDOW, CLOSE, STEP, DEPTH = 4096, 2, 16, 3
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as packed 16-bit numbers, the same as the tokenizer's. A batch is cut at white space, its distinct
    pieces into words and only its distinct words are encoded, with those of the batches before kept."""

    #: Characters whose normal form the tokenizer leaves as it is, lower case apart.
    PLAIN = r"\t-\r\x20-\x7e¡-±´-¸º»¿-įı-ž"
    #: The tokenizer's own split, of pieces without white space.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\pL\pN]+"
    #: Words of one generation that are kept once encoded; the generation before stays for words met again.
    MOST = 150_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        #: Texts for the tokenizer itself: with other characters or with a special token.
        self.odd = "|".join([f"[^{self.PLAIN}]", *(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())])
        # the byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null counts as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        out = self._plain(pc.if_else(odd, "", texts)).to_pylist()
        for k in pc.indices_nonzero(odd).to_pylist():
            out[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint16).tobytes()
        return out

    def _plain(self, texts: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        pieces = split.flatten().dictionary_encode()
        spelled = pc.ascii_split_whitespace(pc.replace_substring_regex(pieces.dictionary, self.WORDS, r"\0 "))
        words = spelled.flatten().dictionary_encode()
        ids = pa.array(self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        nothing = pa.scalar(b"", pa.large_binary())
        by_piece = pc.binary_join(type(spelled).from_arrays(spelled.offsets, ids.take(words.indices)), nothing)
        return pc.binary_join(type(split).from_arrays(split.offsets, by_piece.take(pieces.indices)), nothing)

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from those kept or else from the tokenizer's model."""
        if len(self.newer) >= self.MOST:
            self.newer, self.older = {}, self.newer
        tokenize, newer, older = self.tok.model.tokenize, self.newer, self.older
        out = list(map(newer.get, words))
        for k, word in enumerate(words):
            if out[k] is None:
                found = older.get(word)
                if found is None:
                    shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
                    found = array("H", [t.id for t in tokenize(shown)]).tobytes()
                out[k] = found
                if len(word) < 64 and len(newer) < self.MOST:
                    newer[word] = found
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker, so that what it keeps outlasts a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n, ids): ids is the packed 16-bit ids, closing id included."""
    close = np.array([CLOSE], np.uint16).tobytes()

    def run(batches):
        encode, pack = encoder(path).encode, zstandard.ZstdCompressor(1)
        for b in batches:
            for part in (b.slice(k, BATCH_ROWS) for k in range(0, b.num_rows, BATCH_ROWS)):
                raw = [x + close for x in encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())], names=["rid", "doc_id", "n", "ids"])

    slim = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(released(run), f"rid long, doc_id {slim.schema['doc_id'].dataType.simpleString()}, n long, ids binary")


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of up to `depth` bins (1 to bins) that fill a window of `bins` steps."""
    out = [(bins,)]
    for k in range(2, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, bins), k - 1):
            last = bins - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| with x >= 0: the active-set method. Stopped after `rounds` it is not the minimum yet, but still a
    plan: documents without a slot are packed end to end."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[used] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[k] = True
        while True:
            s = np.zeros_like(x)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if (s[used] > 1e-12).all():
                x = s
                break
            bad = used & (s <= 1e-12)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            used &= x > 1e-12
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, last rank + 1, first sequence, slot): which documents of a bin take which slots."""
    bins = len(histogram) - 1
    shapes = [c for c in combinations(bins) if all(histogram[k] for k in c)]
    if not shapes:
        return []
    a = np.zeros((bins + 1, len(shapes)))
    for j, c in enumerate(shapes):
        for k in c:
            a[k, j] += 1
    counts = nnls(a, histogram.astype(float))
    free, taken, sequence, out = histogram.astype(np.int64).copy(), np.zeros(bins + 1, np.int64), 0, []
    for j in np.argsort(-counts, kind="stable"):
        times = int(min(np.floor(counts[j] + 1e-6), *(free[k] // shapes[j].count(k) for k in shapes[j])))
        if times <= 0:
            continue
        for slot, k in enumerate(shapes[j]):
            out.append((k, int(taken[k]), int(taken[k]) + times, sequence, slot))
            taken[k] += times
            free[k] -= times
        sequence += times
    return out


def running(df: DataFrame, value: str, into: str, *keys: str) -> DataFrame:
    """The sum of value over the rows before, in order of rid (within keys): sums of ranges of rid first."""
    df = df.withColumn("_range", F.shiftright("rid", 16))
    sums = df.groupBy(*keys, "_range").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = Window.partitionBy(*keys, "_range").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(before, [*keys, "_range"]).withColumn(into, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_range", "_before")


def packed(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (16-bit, packed)."""
    spark = documents.sparkSession
    tokens = saved(tokenised(documents, path or tokenizer_path(), id_col, text_col), "uncompressed")
    bins = WINDOW // STEP
    size = tokens.select("rid", "n", F.floor(F.col("n") / WINDOW).cast("long").alias("whole"), (F.col("n") % WINDOW).alias("rest"), F.ceil((F.col("n") % WINDOW) / STEP).cast("int").alias("bin"), F.lit(1).cast("long").alias("one"))
    rows = size.groupBy("bin").agg(F.count("*").alias("c"), F.sum("whole").alias("w")).collect()
    histogram = np.zeros(bins + 1, np.int64)
    for r in rows:
        histogram[r["bin"]] = r["c"]
    histogram[0] = 0
    whole = sum(r["w"] for r in rows)
    slots = plan(histogram)
    mixed = max((s[3] + s[2] - s[1] for s in slots), default=0)
    ranked = running(size.where("rest > 0"), "one", "rank", "bin").select("rid", "rest", "bin", "rank")
    chosen = spark.createDataFrame(slots, "bin int, low long, high long, first long, slot int")
    placed = saved(ranked.join(F.broadcast(chosen), "bin", "left").where("low IS NULL OR (rank >= low AND rank < high)").select("rid", "rest", "slot", (F.col("first") + F.col("rank") - F.col("low")).alias("q")) if slots else ranked.select("rid", "rest", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("q")))
    inside = placed.where("q IS NOT NULL")
    order = Window.partitionBy("q").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    first = inside.select("rid", F.array(F.struct(F.lit(0).cast("long").alias("skip"), F.col("rest").alias("length"), (F.col("q") + whole).alias("sequence"), F.coalesce(F.sum("rest").over(order), F.lit(0)).alias("offset"))).alias("pieces"))
    loose = saved(size.where("rest > 0").select("rid", "rest").join(inside.select("rid"), "rid", "left_anti"))
    laid = running(loose, "rest", "at").withColumn("q", F.floor(F.col("at") / WINDOW).cast("long")).withColumn("o", F.col("at") % WINDOW)
    one = F.least("rest", WINDOW - F.col("o"))
    two = F.col("rest") - one
    base = whole + mixed
    greedy = laid.select("rid", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("skip"), one.alias("length"), (F.col("q") + base).alias("sequence"), F.col("o").alias("offset")), F.struct(one.alias("skip"), two.alias("length"), (F.col("q") + base + 1).alias("sequence"), F.lit(0).cast("long").alias("offset"))), lambda p: p["length"] > 0).alias("pieces"))
    heads = running(size, "whole", "head").select("rid", "head")
    where = saved(heads.join(saved(first.unionByName(greedy)), "rid", "left"))

    def cut(batches):
        for b in batches:
            out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, n, blob, head, pieces in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n", "ids", "head", "pieces")), strict=True):
                raw = np.frombuffer(zstandard.decompress(blob), np.uint16)
                full = n // WINDOW
                spans = [(k * WINDOW, WINDOW, head + k, 0) for k in range(full)] + [(full * WINDOW + p["skip"], p["length"], p["sequence"], p["offset"]) for p in pieces or ()]
                for start, length, sequence, offset in spans:
                    part = raw[start : start + length]
                    for k, v in zip(out, (doc, start, length, zlib.crc32(part.astype("<u4").tobytes()), n, sequence, offset, part.tobytes()), strict=True):
                        out[k].append(v)
            kinds = dict.fromkeys(out, pa.int64()) | {"doc_id": b.schema.field("doc_id").type, "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.join(where, "rid").select("doc_id", "n", "ids", "head", "pieces").mapInArrow(released(cut), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
