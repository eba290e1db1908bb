"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct shingles of five words. How many documents hold each shingle (its list's
length) is counted exactly up to 255, and sets are put in that order, ties by code. A set of n shingles needs at
least T = ceil(0.8 n) of them in any partner, so its T - 1 longest lists are left out of the merge: two sets that
share T shingles share one among the first n - T + 1 of both, and stand early enough there for T to be reached.
The short lists are merged (a shingle of one document only has nothing to merge); the documents met are probed, by
binary search, first in each other's short lists and, if the required overlap is still possible, in the long ones.

Equal sets are one class before the search. A first merge links the members of a list to the one that shares most
lists with others (the middle of a group of copies), so that a group costs a link and not a pair for each member;
the exhaustive merge then only needs pairs of different components.

Lengths are counted where the codes of a range meet: every unit of texts sends its sorted distinct codes, 32 bits
beside the range, and gets a byte for each back. Codes that fall together there only make a list look longer, for
all documents alike.

Defined results: null, empty and word-free texts have an empty set and are linked with nothing; texts under
five words have one shingle; repeated rows are linked like any other equal texts; a null doc_id never names a
component unless all its members lack one; extra columns of the input are ignored; an empty table gives an empty
table. A set is held whole by one task: eight bytes for each word of the longest text, a few times over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks, lower_ascii, mix, prefix_code, released, saved, span_codes, table, utf8, word_spans
from .graph import components

SHINGLE, PERCENT = 5, 80
#: Bytes of texts in a unit, bytes whose shingles are coded at once, rows of a unit at most (12 bits of a row's key).
UNIT, CODED, UNIT_ROWS = 4 << 20, 512 << 10, 1 << 12
#: Packed bytes of texts whose codes meet in one range, the least number of ranges, the longest list told apart.
RANGE_BYTES, LEAST_RANGES, LONGEST = 4 << 20, 96, 255
#: Bytes of sets that a task keeps while it probes.
KEPT = 32 << 20
_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_M = U64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingle codes of each row."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, _SPACE)
    words = span_codes(prefix_code(data), starts, ends)
    n = len(words)
    code = words.copy()
    runs = [code]
    for j in range(1, SHINGLE):
        nxt = np.zeros(n, U64)
        if n > j:
            nxt[: n - j] = mix(code[: n - j] * _M + words[j:] + U64(j))
        code = nxt
        runs.append(code)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        k = b - a
        if k >= SHINGLE:
            out.append(np.unique(code[a : b - SHINGLE + 1]))
        else:
            out.append(mix(runs[k - 1][a : a + 1] + U64(k)) if k else code[:0])
    return out


def units(docs: DataFrame) -> DataFrame:
    """Rows of up to UNIT bytes of whole texts: unit, the ids, the texts' sizes and their packed bytes."""

    def run(batches):
        pack, n = zstandard.ZstdCompressor(3), 0
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ids, part = b.column("doc_id"), b.column("part")
            for x, y in blocks(offsets, UNIT):
                for u in range(x, y, UNIT_ROWS):
                    v = min(y, u + UNIT_ROWS)
                    n += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part[u].as_py() * (1 << 24) + n]), pa.ListArray.from_arrays(pa.array([0, v - u], pa.int32()), ids.slice(u, v - u)), pa.array([np.diff(offsets[u : v + 1]).astype(np.int64).tobytes()], pa.binary()), pa.array([pack.compress(data[offsets[u] : offsets[v]].tobytes())], pa.binary())],
                        names=["unit", "ids", "sizes", "packed"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("part", F.spark_partition_id()).mapInArrow(released(run), f"unit long, ids array<{kind}>, sizes binary, packed binary")


def _texts(sizes: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [s for x, y in blocks(offsets, CODED) for s in shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])]


def _ranges(codes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each of sorted codes, of equal parts of the 64 bits; ranges do not overlap."""
    return ((codes >> U64(40)) * U64(ranges) >> U64(24)).astype(np.int64)


def _sent(rows: DataFrame, ranges: int) -> DataFrame:
    """(range, unit, codes, n): the distinct codes of every unit, cut by range, and how many of its texts have each."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sets = _sets(*_texts(r["sizes"], r["packed"]))
                codes, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, U64), np.zeros(0, int))
                counts = np.bincount(_ranges(codes, ranges), minlength=ranges)
                ends, used = np.cumsum(counts), np.flatnonzero(counts)
                cut = [slice(ends[k] - counts[k], ends[k]) for k in used]
                short, n = codes.astype(np.uint32), np.minimum(n, LONGEST).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), r["unit"], np.int64)), pa.array([short[c].tobytes() for c in cut], pa.binary()), pa.array([n[c].tobytes() for c in cut], pa.binary())],
                    names=["range", "unit", "codes", "n"],
                )

    return rows.select("unit", "sizes", "packed").mapInArrow(released(run), "range int, unit long, codes binary, n binary")


def _lengths(sent: DataFrame) -> DataFrame:
    """(unit, range, n): the length of the list of every code sent, LONGEST at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(x, np.uint32) for x in pdf["codes"]]
        _, place = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["n"]]))
        found = np.split(np.minimum(total, LONGEST).astype(np.uint8)[place], np.cumsum([len(x) for x in codes])[:-1])
        return pd.DataFrame({"unit": pdf["unit"], "range": pdf["range"], "n": [x.tobytes() for x in found]})

    return sent.groupBy("range").applyInPandas(run, "unit long, range int, n binary")


def _index(rows: DataFrame, kind: str) -> DataFrame:
    """Per document: its size, its set's 128-bit code, and what is merged: the shingles on lists of several documents
    among the first n - T + 1, with their positions; the packed text of those that have any."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3)
        for b in batches:
            kinds = b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                data, offsets = _texts(r["sizes"], r["packed"])
                sets = _sets(data, offsets)
                m = len(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)])
                codes = np.concatenate(sets) if m else np.zeros(0, U64)
                _, place = np.unique(codes, return_inverse=True)
                length = np.frombuffer(b"".join(x["n"] for x in sorted(r["lengths"] or (), key=lambda x: x["range"])), np.uint8)[place]
                row = np.repeat(np.arange(m), sizes)
                order = np.argsort(row << 8 | length, kind="stable")
                at = np.arange(len(codes)) - first[row]
                merged = (at < (sizes - (4 * sizes + 4) // 5 + 1)[row]) & (length[order] > 1)
                keys, pos = codes[order][merged].view(np.int64), at[merged].astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[merged], minlength=m))]).astype(np.int32)
                fp = np.array([(int(np.bitwise_xor.reduce(mix(s), initial=0)), int(np.add.reduce(mix(s ^ _M), initial=0))) for s in sets], U64).reshape(-1, 2).view(np.int64)
                blobs = [pack.compress(data[offsets[k] : offsets[k + 1]].tobytes()) if ends[k] < ends[k + 1] else None for k in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["unit"] * UNIT_ROWS + np.arange(m)), pa.array(r["ids"], kinds), pa.array(sizes.astype(np.int32)), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, pos), pa.array(blobs, pa.binary())],
                    names=["rid", "doc_id", "n", "f1", "f2", "keys", "pos", "packed"],
                )

    return rows.mapInArrow(released(run), f"rid long, doc_id {kind}, n int, f1 long, f2 long, keys array<long>, pos array<int>, packed binary")


def index(docs: DataFrame) -> DataFrame:
    """_index of docs (doc_id, text), written."""
    held = saved(units(docs))
    size = held.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    lengths = _lengths(_sent(held, max(LEAST_RANGES, int(size // RANGE_BYTES))))
    by_unit = lengths.groupBy("unit").agg(F.collect_list(F.struct("range", "n")).alias("lengths"))
    return saved(_index(held.join(by_unit, "unit", "left"), docs.schema["doc_id"].dataType.simpleString()))


def _head(n: str):
    """How many shingles of a set of n are merged: n - T + 1 with T = ceil(0.8 n)."""
    return F.col(n) - F.floor((4 * F.col(n) + 4) / 5).cast("int") + 1


def _probed(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity: what one set holds is searched in the other.

    a, which may be in very many pairs, is met last, so that its text is sent for each of its parts only.
    """

    def run(batches):
        unpack, kept, size = zstandard.ZstdDecompressor(), {}, 0

        def sets(rid, blob):
            nonlocal size
            if rid not in kept:
                if size > KEPT:
                    kept.clear()
                    size = 0
                raw = np.frombuffer(unpack.decompress(blob.as_py()), np.uint8)
                kept[rid] = shingle_sets(raw, np.array([0, len(raw)]))[0]
                size += kept[rid].nbytes
            return kept[rid]

        for b in batches:
            keep = []
            for a, x, c, y in zip(b.column("a").to_pylist(), b.column("pa"), b.column("b").to_pylist(), b.column("pb"), strict=True):
                s, t = sorted((sets(a, x), sets(c, y)), key=len)
                both = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s))
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    got = pairs.join(packed.select(F.col("rid").alias("b"), F.col("packed").alias("pb")), "b").join(packed.select(F.col("rid").alias("a"), F.col("packed").alias("pa")), "a")
    return saved(got.select("a", "b", "pa", "pb").mapInArrow(released(run), "a long, b long"))


def _star_links(short: DataFrame, reps: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, nodes): members of a list linked to the one of them that meets most others, if they share enough lists."""
    nodes = saved(short.groupBy("rid").agg(F.sum("m").alias("met")).join(reps.select("rid", "n"), "rid"))
    middle = short.select("key", "rid").join(nodes.select("rid", "met"), "rid").groupBy("key").agg(F.max_by("rid", F.struct("met", "rid")).alias("top"))
    often = short.select("key", "rid").join(middle, "key").where("rid <> top").groupBy(F.col("top").alias("a"), F.col("rid").alias("b")).agg(F.count("*").alias("c"))
    stars = saved(often.join(nodes.select(F.col("rid").alias("b"), "n"), "b").where(10 * F.col("c") >= 3 * _head("n")).select("a", "b"))
    return _probed(stars, packed), nodes


def near_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id): the classes linked by a Jaccard similarity of 0.8 or more."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = index(docs)
    full = found.where("n > 0")
    reps = saved(full.groupBy("f1", "f2").agg(F.min("rid").alias("rid"), F.min_by(F.struct("n", "keys", "pos"), "rid").alias("x")).select("f1", "f2", "rid", "x.n", "x.keys", "x.pos"))
    lists = reps.select("rid", F.inline(F.arrays_zip("keys", "pos"))).withColumnRenamed("keys", "key")
    shared = lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    short = saved(lists.join(shared, "key"))
    packed = found.where("packed IS NOT NULL").select("rid", "packed")
    links, nodes = _star_links(short, reps, packed)
    roots = components(links)
    own = nodes.select("rid", "n").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n", F.coalesce("root", "rid").alias("root"))
    marked = saved(short.select("key", "rid", "pos").join(own, "rid"))
    mixed = marked.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("key")
    open_ = saved(marked.join(mixed, "key"))
    left = open_.select("key", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("pos").alias("ia"))
    right = open_.select("key", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("pos").alias("ib"))
    need = F.ceil((F.col("na") + F.col("nb")) * PERCENT / F.lit(100.0 + PERCENT) - 1e-9)
    early = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need
    fits = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & early
    met = saved(left.join(right, "key").where(fits).select("a", "b", "na", "nb").distinct())
    probed = met.join(reps.select(F.col("rid").alias("a"), F.col("keys").alias("ha")), "a").join(reps.select(F.col("rid").alias("b"), F.col("keys").alias("hb")), "b")
    rest = F.greatest(F.col("na") - _head("na"), F.col("nb") - _head("nb"))
    more = saved(probed.where(F.size(F.array_intersect("ha", "hb")) >= need - rest).select("a", "b"))
    links = links.unionByName(_probed(more, packed))
    roots = components(links)
    rows = found.select("rid", "doc_id", "n", "f1", "f2")
    ids = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"))
    classes = saved(reps.select("f1", "f2", "rid").join(ids, ["f1", "f2"]).join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("f1", "f2", "least", F.coalesce("root", "rid").alias("root")))
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("f1", "f2", "component_id")
    linked = rows.where("n > 0").join(named, ["f1", "f2"]).select("rid", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("rid", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
