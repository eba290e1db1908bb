"""Benchmark decontamination with an FM-index per training shard.

Windows of ten consecutive benchmark words are the test phrases. Every shard (a block of whole documents)
is written as a sequence of word symbols; words that occur in no phrase, and document ends, are one separator,
as no phrase can reach over them. Over this sequence the shard builds a suffix array, the Burrows-Wheeler
transform as a wavelet matrix and sampled suffix positions. All phrases are searched backwards at once,
occurrences are located from the samples, and the hit words are merged into removal spans.

Phrases are written once and dealt into blocks of about PHRASES; each block is one pass over the documents, written
before the next, whose block takes its place: the driver and every worker hold one block at a time, whatever the size
of the benchmark. A shard is whole documents of up to SHARD bytes; a longer one is a shard of its own.

Defined results: null, empty and word-free texts have no words and are clean; items without words have no
window; an item of fewer than ten words is one window; a null item_id marks words but names no item; repeated
rows and items are judged alike; extra columns stay, and those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks, lower_ascii, plus, prefix_code, released, saved, span_codes, table, utf8, word_spans

WINDOW, PHRASES, SHARD, SAMPLE = 10, 200_000, 2 << 20, 8
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word codes, starts, ends, first word of each row)."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, _WORD)
    return span_codes(prefix_code(data), starts, ends), starts, ends, first


class FMIndex:
    """Full-text index over symbols >= 1; 0 ends the text."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.append(symbols, 0).astype(np.int64)
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank, h = np.zeros(n, np.int64), 1
        rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
        while rank.max() < n - 1:
            key = rank * n
            key[: n - h] += rank[h:]
            order = np.argsort(key, kind="stable")
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            h *= 2
        bwt = text[order - 1]
        self.n, self.levels = n, max(1, int(sigma).bit_length())
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 2))])
        self.ones, self.zeros, now = [], [], bwt
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.bwt = bwt
        sampled = order % SAMPLE == 0
        self.sampled, self.sample_rank, self.positions = sampled, np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level) & 1 == 1
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each phrase (rows of symbols, right-padded)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            use = live[sizes[live] > j]
            c = phrases[use, j]
            low[use] = self.below[c] + self.rank(c, low[use])
            high[use] = self.below[c] + self.rank(c, high[use])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the nearest sample."""
        out, open_, now, steps = np.zeros(len(at), np.int64), np.arange(len(at)), at.copy(), 0
        while len(open_):
            hit = self.sampled[now]
            out[open_[hit]] = self.positions[self.sample_rank[now[hit]]] + steps
            open_, now = open_[~hit], now[~hit]
            c = self.bwt[now]
            now = self.below[c] + self.rank(c, now)
            steps += 1
        return out


class Phrases:
    """One block of phrases: their vocabulary, symbols and items."""

    def __init__(self, pdf: pd.DataFrame):
        rows = [np.frombuffer(x, U64) for x in pdf["codes"]]
        self.items, owner = np.unique(pdf["item"].fillna("").to_numpy(str), return_inverse=True) if len(pdf) else (np.zeros(0, str), np.zeros(0, int))
        self.named = ~np.isin(np.arange(len(self.items)), owner[pdf["item"].isna().to_numpy()]) if len(pdf) else np.zeros(0, bool)
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, U64)
        keys = pdf["codes"].to_numpy()
        first: dict = {}
        which = np.array([first.setdefault(k, len(first)) for k in keys], np.int64)
        self.sizes = np.zeros(len(first), np.int64)
        self.symbols = np.zeros((len(first), WINDOW), np.int64)
        for k, p in first.items():
            codes = np.frombuffer(k, U64)
            self.sizes[p] = len(codes)
            self.symbols[p, : len(codes)] = np.searchsorted(self.vocabulary, codes) + 2
        pairs = np.unique(np.stack([which, owner]), axis=1) if len(pdf) else np.zeros((2, 0), np.int64)
        self.owner = pairs[1]
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(first) + 1))


def phrases_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, codes): the windows of every item."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            codes, _, _, first = words_of(data, offsets)
            names, out_item, out_codes = b.column("item").to_pylist(), [], []
            for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                for s in range(x, max(x + 1, y - WINDOW + 1)) if y > x else ():
                    out_item.append(names[k])
                    out_codes.append(codes[s : min(y, s + WINDOW)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_item, pa.string()), pa.array(out_codes, pa.binary())], names=["item", "codes"])

    slim = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "item string, codes binary").distinct()


def search_shard(block: Phrases, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, phrases) of all occurrences of the block's phrases among a shard's words."""
    none = np.zeros(0, np.int64)
    if not len(block.vocabulary) or not len(codes):
        return none, none, none
    place = np.minimum(np.searchsorted(block.vocabulary, codes), len(block.vocabulary) - 1)
    symbol = np.where(block.vocabulary[place] == codes, place + 2, 1)
    known = symbol > 1
    row = np.searchsorted(first, np.arange(len(codes)), side="right")
    # maximal runs of known words; shorter ones than the shortest phrase hold none
    new = np.ones(len(codes), bool)
    new[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(codes)))
    keep = known[at] & (sizes >= block.sizes.min())
    at, sizes = at[keep], sizes[keep]
    if not len(at):
        return none, none, none
    gaps = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int((sizes + 1).sum()), np.int64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    to, source = np.repeat(gaps, sizes) + inner, np.repeat(at, sizes) + inner
    text[to] = symbol[source]
    back = np.full(len(text), -1, np.int64)
    back[to] = source
    index = FMIndex(text, len(block.vocabulary) + 2)
    low, high = index.search(block.symbols, block.sizes)
    found = np.flatnonzero(low < high)
    n = high[found] - low[found]
    phrase = np.repeat(found, n)
    rows = np.repeat(low[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return back[index.locate(rows)], block.sizes[phrase], phrase


def _pass(documents: DataFrame, text: str, block, first_pass: bool) -> DataFrame:
    def run(batches):
        phrases = block.value
        for b in batches:
            data, offsets = utf8(b.column(text))
            n_words, hits, items = [], [], []
            old_hits = None if first_pass else b.column("hit_words").to_pylist()
            old_items = None if first_pass else b.column("items").to_pylist()
            for x, y in blocks(offsets, SHARD):
                codes, _, _, first = words_of(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                start, size, phrase = search_shard(phrases, codes, first)
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                doc = np.searchsorted(first, start, side="right") - 1
                got: dict = {}
                for d, p in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
                    got.setdefault(d, set()).update(phrases.owner[phrases.owner_at[p] : phrases.owner_at[p + 1]].tolist())
                hit = np.cumsum(edge[:-1]) > 0
                for k in range(y - x):
                    a, e = int(first[k]), int(first[k + 1])
                    n_words.append(e - a)
                    names = {str(phrases.items[i]) for i in got.get(k, ()) if phrases.named[i]}
                    own = hit[a:e]
                    if not first_pass:
                        names |= set(old_items[x + k])
                        own = own.copy()
                        for s in old_hits[x + k]:
                            own[s["start"] : s["end"]] = True
                    step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]])) if k in got or not first_pass else np.zeros(0)
                    hits.append([{"start": int(s), "end": int(t)} for s, t in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                    items.append(sorted(names))
            keep = [c for c in b.schema.names if c not in ("n_words", "hit_words", "items")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "n_words", "hit_words", "items"],
            )

    schema = plus(documents.drop("n_words", "hit_words", "items"), n_words="long", hit_words="array<struct<start: long, end: long>>", items="array<string>")
    return documents.mapInArrow(released(run), schema)


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """documents with n_words, hit_words (merged spans, as word numbers) and items (ids of the items found)."""
    phrases = saved(phrases_of(benchmark))
    n = phrases.count()
    n_blocks = max(1, -(-n // PHRASES))
    context = documents.sparkSession.sparkContext
    out = documents.drop("n_words", "hit_words", "items")
    for k in range(n_blocks):
        block = phrases.where(F.pmod(F.xxhash64("codes"), F.lit(n_blocks)) == k) if n_blocks > 1 else phrases
        held = context.broadcast(Phrases(block.toPandas()))
        out = _pass(out, text, held, k == 0)
        if k + 1 < n_blocks:
            out = saved(out)
            held.destroy()
    return out


def without_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """found with its hit words, and all between the first and last word of a span, cut out of the text."""

    def run(batches):
        for b in batches:
            column = b.column(text).to_pylist()
            for k, spans in enumerate(b.column("hit_words").to_pylist()):
                if spans:
                    raw = column[k].encode()
                    data = np.frombuffer(raw, np.uint8)
                    _, starts, ends, _ = words_of(data, np.array([0, len(data)]))
                    parts, at = [], 0
                    for s in spans:
                        parts.append(raw[at : starts[s["start"]]])
                        at = ends[s["end"] - 1]
                    column[k] = b"".join([*parts, raw[at:]]).decode()
            at = b.schema.get_field_index(text)
            columns = list(b.columns)
            columns[at] = pa.array(column, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    cut = found.mapInArrow(released(run), found.schema)
    return cut.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in found.columns else cut


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
