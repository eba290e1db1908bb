"""Fill-in-middle transformation with an indexable skip list over the units of a text.

A unit is a run of ASCII letters or one other character. Every link of the list carries two widths, the units and the
code points (and bytes) it passes: lane 0 has a node each STEP units, lane k one each STEP ** (k + 1), up to a lane of
at most STEP nodes. A cut rank is reached from the top lane down, going on while the accumulated units stay within the
rank, and the last units are walked in the bytes themselves; both cuts of a document use the same list.

A document's form and ranks come from the SHA-256 of its id, so a rerun gives the same rows. Texts are cut as bytes
and never leave their task; nothing is shuffled.

Defined results: a null text is an empty one, and plain; a text that holds a marker is plain; a null doc_id is hashed
as an empty one; repeated rows give repeated results; an empty table gives an empty table; further columns are ignored
by the query and passed through by `with_infill` unless they have a name of its own. A text is held with one array of
its unit starts, block by block of BLOCK bytes, and its list of one node for each STEP units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, released, table

MARKS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = MARKS
#: Of 100: documents that are cut at all, and among these such in the order suffix, prefix, middle.
CUT, SPM = 90, 20
STEP, BLOCK = 64, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _units(raw: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a unit begins, whether a code point begins) at each byte; before: the byte ahead of raw, or 0."""
    point = (raw & 0xC0) != 0x80
    letter = _LETTER[raw]
    follows = np.empty(len(raw), bool)
    if len(raw):
        follows[0], follows[1:] = _LETTER[before], letter[:-1]
    return point & ~(letter & follows), point


class UnitList:
    """The skip list of one text (UTF-8 bytes)."""

    def __init__(self, text: bytes):
        self.raw = np.frombuffer(text, np.uint8)
        ends: list[np.ndarray] = []  # (units, code points, bytes) before each node of lane 0
        units = points = 0
        for at in range(0, len(text), BLOCK):
            begins, point = _units(self.raw[at : at + BLOCK], int(self.raw[at - 1]) if at else 0)
            where = np.flatnonzero(begins)
            nodes = where[(-units) % STEP :: STEP]  # units whose number is a multiple of STEP
            rank = units + (-units) % STEP + STEP * np.arange(len(nodes), dtype=np.int64)
            ends.append(np.stack([rank, points + np.cumsum(point, dtype=np.int64)[nodes] - 1, at + nodes], axis=1))
            units, points = units + len(where), points + int(point.sum())
        self.n, self.points = units, points
        stops = np.concatenate([*ends, np.array([[units, points, len(text)]], np.int64)])
        #: lanes[k]: the widths (units, code points, bytes) of the links of lane k
        self.lanes = [np.diff(stops, axis=0)]
        while len(self.lanes[-1]) > STEP:
            low = self.lanes[-1]
            self.lanes.append(np.add.reduceat(low, np.arange(0, len(low), STEP), axis=0))

    def seek(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of this rank; the rank n is the end."""
        at = np.zeros(3, np.int64)
        link = 0
        for lane in reversed(self.lanes):
            ways = lane[link : link + STEP]
            sums = np.cumsum(ways, axis=0)
            passed = int(np.searchsorted(sums[:, 0] + at[0], rank, side="right"))
            if passed:
                at = at + sums[passed - 1]
            link = (link + passed) * STEP
        left, begin = rank - int(at[0]), int(at[2])
        if not left:
            return int(at[1]), begin
        size = 4 * STEP
        while True:  # the units short of the rank, in the text itself
            begins, point = _units(self.raw[begin : begin + size], int(self.raw[begin - 1]) if begin else 0)
            where = np.flatnonzero(begins)
            # the unit at begin is number 0 here
            if len(where) > left:
                stop = int(where[left])
                return int(at[1]) + int(point[:stop].sum()), begin + stop
            if begin + size >= len(self.raw):
                return self.points, len(self.raw)
            size *= 4


def form_of(text: bytes, h3: int, h4: int) -> str:
    if not text or h3 % 100 >= CUT or any(m in text for m in MARKS):
        return "plain"
    return "spm" if h4 % 100 < SPM else "psm"


def transformed(text: bytes, h: tuple) -> tuple:
    """(n, form, code points of prefix and middle or None, output)."""
    units = UnitList(text)
    form = form_of(text, h[2], h[3])
    if form == "plain":
        return units.n, form, None, None, text
    low, high = sorted(x % (units.n + 1) for x in h[:2])
    (p_points, p), (m_points, m) = units.seek(low), units.seek(high)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    output = b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return units.n, form, p_points, m_points - p_points, output


def restored(output: bytes, form: str) -> bytes:
    """The text again: the markers of a cut text are the first of their kind, as no text with markers is cut."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at = output.index(second, 3)
    end = output.index(MIDDLE, at + 3)
    first, other, middle = output[3:at], output[at + 3 : end], output[end + 3 :]
    return first + middle + other if form == "psm" else other + middle + first


def with_infill(docs: DataFrame) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output of every text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    ranks = F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))
    own = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    rows = docs.drop(*own, "_ranks").withColumn("_ranks", ranks)
    schema = plus(docs.drop(*own, "_ranks"), **own)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, h = names.index("text"), names.index("_ranks")
            found = [transformed((t.as_py() or "").encode(), tuple(x.as_py())) for t, x in zip(batch.column(text), batch.column(h), strict=True)]
            columns = [batch.column(k) for k in range(len(names)) if k != h]
            for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64())):
                columns.append(pa.array([f[k] for f in found], kind))
            columns.append(pa.array([f[4] for f in found], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*(c for c in names if c != "_ranks"), *own])

    return rows.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars with the SHA-256 of the output and of the text rebuilt from it."""
    schema = plus(found.select("doc_id", "n", "form", "prefix_chars", "middle_chars"), output_sha256="string", restored_sha256="string")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(hashlib.sha256(o := text.as_py().encode()).hexdigest(), hashlib.sha256(restored(o, form.as_py())).hexdigest()) for text, form in zip(batch.column("output"), batch.column("form"), strict=True)]
            kept = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([a for a, _ in sums], pa.string()), pa.array([b for _, b in sums], pa.string())], schema.names)

    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(run, schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_infill(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(u[1:p], '') AS prefix, array_to_string(u[p + 1:q], '') AS middle, array_to_string(u[q + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
