"""Repeated substrings by distributed prefix doubling on coded ranks.

A document's bytes covered by a string of `length` bytes that also starts in a document with a smaller id are
found. A position's rank among strings of h bytes is a 64-bit code of these bytes; equal strings, equal codes.
  1. h = length / 2. Ranks are compared at sampled positions only: each window of `length` bytes is known by
     its smallest rank (the same for equal windows), so a window whose sample is unique drops out at once.
  2. Runs of windows with one sample are ranked as wholes; runs that a smaller document holds are done, and
     of runs with one sample but different contents one holder each goes on.
  3. Doubling: the windows left are ranked by the pair (rank at i, rank at i + h), which passes the threshold.
Each round sends sorted ranks to the task of their range, where they are sorted together, and gets a bit for
each back. Texts stay where they are but for the join with the bits. Only codes are compared: two different
strings share a 64-bit code with a chance near 1e-4 for 100 million ranks of one range.

Defined results: null and empty texts have no bytes and the hash of nothing; texts shorter than `length` lose
nothing; rows with equal ids (repeated rows) do not count against each other; a null id is larger than all
others; extra columns are ignored; an empty table gives an empty table. Ids are whole numbers, as smaller ones come
first; others are an error. A text is never split: a task holds about a hundred bytes for each byte of its longest.

Prefix doubling over all positions would send 16 bytes for each byte of text and round. The sampled first round, and
whole runs in the second, stand in for the rounds of growing offsets: they only settle windows whose answer is known,
and the last round ranks pairs at a growing offset for those left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks, mix, powers, prefix_code, saved, table, utf8

CHUNK = 2 << 20
RANGE_BYTES, LEAST_RANGES = 12 << 20, 96
_M = U64(0x9FB21C651E98DF25)
_NONE = np.iinfo(np.int64).max


def _chunks(documents: DataFrame) -> DataFrame:
    """Rows of about CHUNK bytes of whole documents: ids, missing ids, row ends and the packed bytes."""

    def run(batches):
        pack, n = zstandard.ZstdCompressor(3), 0
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ids, part = b.column("doc_id"), b.column("part")
            for x, y in blocks(offsets, CHUNK):
                n += 1
                sizes = np.diff(offsets[x : y + 1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[x].as_py() * (1 << 33) + n]), pa.array([ids[x:y].to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tobytes()], pa.binary()), pa.array([pack.compress(data[offsets[x] : offsets[y]].tobytes())], pa.binary())],
                    names=["chunk", "ids", "sizes", "packed"],
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return docs.mapInArrow(run, "chunk long, ids array<long>, sizes binary, packed binary")


class Chunk:
    """One chunk's windows, samples and runs; the same whenever it is built again."""

    def __init__(self, ids: list, sizes: bytes, packed: bytes, length: int):
        self.ids = np.array([_NONE if i is None else i for i in ids], np.int64)
        self.raw_ids, self.length = ids, length
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        self.ends = np.cumsum(np.frombuffer(sizes, np.int64))
        self.offsets = np.concatenate([[0], self.ends])
        self.half, width = length // 2, length - length // 2 + 1
        n = len(self.data)
        self.n = max(0, n - length + 1)
        if not self.n:
            self.first = self.last = np.zeros(0, np.int64)
            self.sample = self.rank = np.zeros(0, U64)
            self.code = np.zeros(1, U64)
            self.doc = np.zeros(0, np.int64)
            return
        self.code = prefix_code(self.data)
        _, down = powers(n + 1)
        self.rank = (self.code[self.half :] - self.code[: -self.half]) * down[: n + 1 - self.half]
        low, span = self.rank, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        low = low[: self.n]
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.offsets))[: self.n]
        ok = np.arange(self.n) + length <= self.ends[row]
        new = np.ones(self.n, bool)
        new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
        cut = np.flatnonzero(new)
        last = np.append(cut[1:], self.n) - 1
        keep = ok[cut]
        #: Runs of windows with one sample: first and last window, sample, document.
        self.first, self.last = cut[keep], last[keep]
        self.sample = mix(low[self.first])
        self.doc = self.ids[row[self.first]]

    def runs(self, which: np.ndarray) -> np.ndarray:
        """A code of the whole content of each run."""
        a, e = self.first[which], self.last[which] + self.length
        _, down = powers(len(self.code))
        return mix((self.code[e] - self.code[a]) * down[a] + (e - a).astype(U64) * _M + self.sample[which])

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The code of the rank pair of each window."""
        return mix(mix(self.rank[at]) * _M + self.rank[at + self.length - self.half])


def _least(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, the smallest document of each, and the place of every code among them."""
    distinct, place = np.unique(codes, return_inverse=True)
    low = np.full(len(distinct), _NONE, np.int64)
    np.minimum.at(low, place, docs)
    return distinct, low, place


def _bits(replies, round_: int, ranges: int, counts: np.ndarray) -> np.ndarray:
    """A round's answers for a chunk in the order of its codes, which are sorted by range and code."""
    out = np.zeros(int(counts.sum()), np.uint8)
    ends = np.cumsum(counts)
    for r in replies or ():
        if r["round"] == round_ and counts[r["range"]]:
            k = r["range"]
            out[ends[k] - counts[k] : ends[k]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _ranges(codes: np.ndarray, ranges: int) -> np.ndarray:
    return ((codes >> U64(40)) * U64(ranges) >> U64(24)).astype(np.int64)


def _work(chunk: Chunk, replies, ranges: int, done_rounds: int) -> dict:
    """All that is known of a chunk after the rounds that are done (a chunk of short texts has no answers)."""
    state: dict = {}
    key, low, place = _least(chunk.sample, chunk.doc)
    counts = np.bincount(_ranges(key, ranges), minlength=ranges)
    state[1] = (key, low, counts)
    if done_rounds < 1:
        return state
    high = np.full(len(key), np.iinfo(np.int64).min)
    np.maximum.at(high, place, chunk.doc)
    alive = np.flatnonzero((_bits(replies, 1, ranges, counts).astype(bool) | (high > low))[place])
    run = chunk.runs(alive)
    # runs are sent to the range of their sample: order by (range, run)
    area = _ranges(chunk.sample[alive], ranges)
    order = np.lexsort((run, area))
    alive, run, area = alive[order], run[order], area[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (area[1:] != area[:-1])
    at = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    least = np.minimum.reduceat(chunk.doc[alive], at) if len(at) else np.zeros(0, np.int64)
    counts2 = np.bincount(area[at], minlength=ranges)
    state[2] = (run[at], least, counts2, chunk.sample[alive[at]])
    state["runs"] = (alive, which, least)
    if done_rounds < 2:
        return state
    bits = _bits(replies, 2, ranges, counts2)
    done, go_on = (bits & 1).astype(bool), (bits & 2).astype(bool)
    mine = chunk.doc[alive] == least[which]
    state["covered"] = alive[done[which] | ~mine]
    left = alive[go_on[which] & mine & ~done[which]]
    sizes = chunk.last[left] - chunk.first[left] + 1
    at = np.repeat(chunk.first[left] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    docs = np.repeat(chunk.doc[left], sizes)
    key3, low3, place3 = _least(chunk.windows(at) if len(at) else np.zeros(0, U64), docs)
    counts3 = np.bincount(_ranges(key3, ranges), minlength=ranges)
    state[3] = (key3, low3, counts3)
    if done_rounds >= 3:
        state["windows"] = at[_bits(replies, 3, ranges, counts3).astype(bool)[place3] | (docs > low3[place3])]
    return state


def _send(chunks: DataFrame, round_: int, ranges: int, length: int) -> DataFrame:
    """(range, chunk, codes, documents): the sorted ranks of a round, cut by range."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3)
        for b in batches:
            for r in b.to_pylist():
                chunk = Chunk(r["ids"], r["sizes"], r["packed"], length)
                got = _work(chunk, r.get("replies"), ranges, round_ - 1)[round_]
                codes, low, counts = got[:3]
                ends = np.cumsum(counts)
                rows: dict = {k: [] for k in ("range", "codes", "local", "docs", "samples")}
                for k in np.flatnonzero(counts):
                    part = slice(ends[k] - counts[k], ends[k])
                    rows["range"].append(int(k))
                    # the first round only looks for other chunks with a sample: 32 bits beside the range will do
                    rows["codes"].append((codes[part].astype(np.uint32) if round_ == 1 else codes[part]).tobytes())
                    # documents as places in a table of the part's own, so that a row grows with its codes only
                    docs, local = np.unique(low[part], return_inverse=True) if round_ > 1 else (low[:0], low[:0])
                    rows["local"].append(local.astype(np.uint32 if len(docs) > 65535 else np.uint16).tobytes())
                    rows["docs"].append(pack.compress(np.diff(docs, prepend=0).astype(np.int64).tobytes()) if round_ > 1 else b"")
                    rows["samples"].append(got[3][part].astype(np.uint32).tobytes() if round_ == 2 else b"")
                n = len(rows["range"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["range"], pa.int32()), pa.array([r["chunk"]] * n, pa.int64()), *(pa.array(rows[k], pa.binary()) for k in ("codes", "local", "docs", "samples"))],
                    names=["range", "chunk", "codes", "local", "docs", "samples"],
                )

    return chunks.mapInArrow(run, "range int, chunk long, codes binary, local binary, docs binary, samples binary")


def _rank(sent: DataFrame, round_: int) -> DataFrame:
    """(chunk, round, range, bits): sorts the ranks of a range together and answers each of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = np.uint32 if round_ == 1 else U64
        codes = [np.frombuffer(x, width) for x in pdf["codes"]]
        sizes = [len(x) for x in codes]
        all_ = np.concatenate(codes)
        if round_ == 1:
            distinct, place, n = np.unique(all_, return_inverse=True, return_counts=True)
            bits = (n > 1)[place].astype(np.uint8)
        else:
            docs = []
            for t, x, n in zip(pdf["docs"], pdf["local"], sizes, strict=True):
                docs.append(np.cumsum(np.frombuffer(zstandard.decompress(t), np.int64))[np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)])
            docs = np.concatenate(docs)
            distinct, low, place = _least(all_, docs)
            bits = (low[place] < docs).astype(np.uint8)
            if round_ == 2:
                sample = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["samples"]])
                one = np.zeros(len(distinct), np.uint32)
                one[place] = sample
                names, n = np.unique(one, return_counts=True)
                bits |= ((n > 1)[np.searchsorted(names, sample)] & (bits == 0)).astype(np.uint8) << 1
        cut = np.split(bits, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "round": round_, "range": pdf["range"], "bits": [x.tobytes() for x in cut]})

    return sent.groupBy("range").applyInPandas(run, "chunk long, round int, range int, bits binary")


def repeated_spans(documents: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256): the removed byte runs of every document."""
    chunks = saved(_chunks(documents))
    total = chunks.agg(F.sum(F.octet_length("packed")) * 3).first()[0] or 0
    ranges = max(LEAST_RANGES, int(total // RANGE_BYTES))
    replies, known = None, chunks
    for round_ in (1, 2, 3):
        got = saved(_rank(_send(known, round_, ranges, length), round_))
        replies = got if replies is None else replies.unionByName(got)
        known = chunks.join(replies.groupBy("chunk").agg(F.collect_list(F.struct("round", "range", "bits")).alias("replies")), "chunk", "left")

    def finish(batches):
        for b in batches:
            for r in b.to_pylist():
                chunk = Chunk(r["ids"], r["sizes"], r["packed"], length)
                edge = np.zeros(len(chunk.data) + 1, np.int32)
                if r["replies"]:
                    state = _work(chunk, r["replies"], ranges, 3)
                    runs, at = state["covered"], state["windows"]
                    np.add.at(edge, chunk.first[runs], 1)
                    np.add.at(edge, chunk.last[runs] + length, -1)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ids, sizes, spans, hashes = [], [], [], []
                for k, (a, e) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
                    flag = np.zeros(e - a + 2, np.int8)
                    flag[1:-1] = gone[a:e]
                    step = np.diff(flag)
                    from_, to = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    ids.append(chunk.raw_ids[k])
                    sizes.append(e - a)
                    spans.append([{"start": int(s), "end": int(t)} for s, t in zip(from_, to, strict=True)])
                    hashes.append(hashlib.sha256(chunk.data[a:e][~gone[a:e]].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(hashes)],
                    names=["doc_id", "n_bytes", "spans", "kept_sha256"],
                )

    return known.select("chunk", "ids", "sizes", "packed", "replies").mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
