"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`, by Viterbi
with survivor coalescence.

The states are what is written so far: nothing, a system turn, a user turn last, an assistant turn last. Each state
keeps one survivor, the cheapest edits that lead to it (ties: the least in ASCII). Survivors are leaves of a tree of
backpointers whose nodes hold a run of edits and know who refers to them; a node that nobody refers to goes, and with
it its ancestors as far as they have no other child; a node that is left with one child becomes one run with it, so
the tree never has more than a few nodes, and what is unsettled takes one byte an edit. As soon as all survivors hang
on one child of the root, its edits are settled and leave the tree. Equal costs are decided by the order of the
complete unsettled paths, which is kept as a rank of each survivor. Survivors that can no longer win are cut: an assistant turn last can do whatever "nothing" can for at most 2 more, and whatever "system"
can for no more.

Rows come sorted by (conversation, turn) through a stream of batches, so a conversation is never held as a whole: what
stays is the tree, one running SHA-256 for each survivor, and the settled edits, one byte each. Whether a row repeats
an earlier one is found before, by Spark: the first turn of each role and text of a conversation comes from a grouping
of codes that adds up on the map side, and joins the stream as a narrow row before the one it marks, so neither a hot
text nor the texts seen so far are gathered anywhere, and texts are shuffled once.

Defined results: nulls in conv_id, turn, role and text count as one space in the damage and in the rows (a null
conv_id is one conversation, returned as null); turns are ordered nulls first, then by role and the SHA-256 of role
and text, so ties have a fixed order; repeated rows are duplicates; an empty role has no initial, which fits nowhere; an empty table gives an
empty table; extra columns are ignored. A conversation of any length is one task's stream, since its digest is one
SHA-256 over its turns in order; a hot one takes time in proportion to its rows, not memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a role's initial leads from each state, and the turns that can be inserted.
STEPS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERTS = ((NONE, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
#: Kinds of rows in a stream, in their order at one place.
DROPPED, FIRST, ROW = range(3)


class Node:
    """A run of edits after another node; who refers to it: its children, and a survivor if it is held."""

    __slots__ = ("children", "held", "parent", "run")

    def __init__(self, parent: Node | None, run: bytes = b""):
        self.parent, self.run, self.held, self.children = parent, bytearray(run), True, set()
        if parent is not None:
            parent.children.add(self)


class Survivors:
    """The best edits of each state while the rows of one conversation pass.

    A survivor is (cost, node, digest of the turns written, whether any is, key). Keys order the complete unsettled
    paths: after a row no path is the beginning of another, so their order can only be refined by what is added, and
    (rank before the row, edits since) compares two paths whole without a walk along them.
    """

    def __init__(self):
        self.root = Node(None)
        self.best: dict = {NONE: (0, self.root, hashlib.sha256(), False, (0, b""))}
        self.settled: list[bytes] = []
        self.nodes = self.most_nodes = 1

    def _give_up(self, node: Node) -> None:
        """A survivor less: what nobody refers to goes, and a node left with one child is one run with it."""
        node.held = False
        while node is not self.root and not node.held and not node.children:
            node.parent.children.discard(node)
            self.nodes -= 1
            node = node.parent
        if node is not self.root and not node.held and len(node.children) == 1:
            (child,) = node.children
            node.run += child.run
            child.run, child.parent = node.run, node.parent
            node.parent.children.discard(node)
            node.parent.children.add(child)
            self.nodes -= 1

    def _offer(self, offers: dict, state: int, cost: int, edit: bytes, came: int, turn: str | None) -> None:
        """The edit as a way to the state, if it is cheaper than the one known, or as cheap and before it in ASCII."""
        rank, since = self.best[came][4]
        key = (rank, since + edit)
        if state not in offers or (cost, key) < offers[state][:2]:
            offers[state] = (cost, key, edit, came, turn)

    def _move(self, offers: dict, kept: dict) -> None:
        """The offers become survivors beside those kept; the others are given up."""
        new = dict(kept)
        for state, (cost, key, edit, came, turn) in offers.items():
            _, node, digest, some, _ = self.best[came]
            if turn is not None:
                digest = digest.copy()
                digest.update((("\n" if some else "") + turn).encode())
                some = True
            new[state] = (cost, Node(node, edit), digest, some, key)
            self.nodes += 1
        gone = [b[1] for s, b in self.best.items() if s not in kept]
        self.best = new
        for node in gone:
            self._give_up(node)
        self.most_nodes = max(self.most_nodes, self.nodes)

    def _insert(self) -> None:
        """Turns inserted where that is cheaper, or as cheap and before in ASCII."""
        for _ in range(2):
            offers: dict = {}
            for came, state in INSERTS:
                if came in self.best:
                    cost, (rank, since) = self.best[came][0] + INSERT, self.best[came][4]
                    own = self.best.get(state)
                    if own is None or (cost, (rank, since + b"I")) < (own[0], own[4]):
                        self._offer(offers, state, cost, b"I", came, f"{ROLES[state]}:")
            if not offers:
                return
            self._move(offers, {s: b for s, b in self.best.items() if s not in offers})

    def _settle(self) -> None:
        """Cuts survivors that cannot win, ranks the others, takes what they share out of the tree."""
        if ASSISTANT in self.best:
            limit = self.best[ASSISTANT][0]
            for state, spare in ((NONE, DELETE), (SYSTEM, 0)):
                if state in self.best and self.best[state][0] > limit + spare:
                    self._give_up(self.best.pop(state)[1])
        for rank, state in enumerate(sorted(self.best, key=lambda s: self.best[s][4])):
            self.best[state] = (*self.best[state][:4], (rank, b""))
        if not self.root.held and len(self.root.children) == 1:
            (self.root,) = self.root.children
            self.settled.append(bytes(self.root.run))
            self.root.run, self.root.parent = bytearray(), None
            self.nodes -= 1

    def row(self, role: str, text: str, fault: str | None) -> None:
        """One row: kept, given another role or deleted, with turns inserted before it where that pays."""
        self._insert()
        offers: dict = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for state, (cost, *_) in self.best.items():
            self._offer(offers, state, cost + DELETE, b"D", state, None)
            if fault in ("blank", "duplicate"):
                continue
            kept = STEPS.get((state, role[:1]))
            if kept is not None:
                self._offer(offers, kept, cost + extra, b"K", state, f"{role}:{text}")
            for initial, to in (("u", USER), ("a", ASSISTANT)):
                if STEPS.get((state, initial)) == to:
                    self._offer(offers, to, cost + REROLE + extra, b"R", state, f"{ROLES[to]}:{text}")
        self._move(offers, {})
        self._settle()

    def deleted(self, count: int) -> None:
        """So many rows that have to go: after the first, only every survivor's last run grows."""
        if count > 0:
            self.row("", "", "blank")
        for state, (cost, node, *rest) in self.best.items() if count > 1 else ():
            if node is self.root:  # a single survivor has no unsettled edits
                self.settled.append(b"D" * (count - 1))
            else:
                node.run += b"D" * (count - 1)
            self.best[state] = (cost + DELETE * (count - 1), node, *rest)

    def end(self) -> tuple[int, str, str]:
        """(cost, edits, digest) of the best conversation that may end here."""
        self._insert()
        cost, node, digest, _, _ = min((self.best[s] for s in (NONE, ASSISTANT) if s in self.best), key=lambda b: (b[0], b[4]))
        path = []
        while node is not self.root:
            path.append(bytes(node.run))
            node = node.parent
        return cost, b"".join([*self.settled, *path[::-1]]).decode(), digest.hexdigest()


class Conversation:
    """Counts and survivors of one conversation."""

    def __init__(self, key: object):
        self.key, self.survivors = key, Survivors()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = self.initial = self.fresh = None

    def add(self, turn: int | None, role: str, text: str, code: bytes, n: int) -> None:
        """A row after damage; n: it and its adjacent repetitions."""
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        self.illegal += n - 1 + (self.initial is not None and self.initial + initial not in LEGAL)
        self.initial = initial
        first, self.fresh = code == self.fresh, None
        end = text.rstrip(SPACE)
        if not end or not first:
            self.blank += 0 if end else n
            self.duplicate += n if end else 0
            self.survivors.deleted(n)
            return
        whole = end[-1] in ".!?"
        self.truncated += not whole
        self.duplicate += n - 1
        self.survivors.row(role, text, None if whole else "truncated")
        self.survivors.deleted(n - 1)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.survivors.end(), self.survivors.most_nodes)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (a null as one space), n and kind: the rows after damage, n times each.

    Rows that the damage drops stay as rows of kind DROPPED, so that their conversation is not lost.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    v = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(v <= 1, "").when(v == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(v == 0, "").when(v == 4, "user").otherwise(space("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(v == 3, 2).otherwise(1).alias("n"), F.when(v == 0, DROPPED).otherwise(ROW).alias("kind"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("n"), F.lit(ROW).alias("kind"))


def _code(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def in_order(rows: DataFrame, *before: DataFrame) -> DataFrame:
    """rows and the narrow rows before them, each conversation in order within one partition."""
    for more in before:
        rows = rows.unionByName(more)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "code", "kind")


def _coded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("code", F.when(F.col("kind") == ROW, _code(F.col("role"), F.col("text"))))


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit, repaired_sha256 and most_nodes of every conversation of damaged() or undamaged()."""
    coded = _coded(rows)
    first = F.when(F.count("turn") == F.count("*"), F.min("turn")).alias("turn")  # a null turn is the first
    firsts = coded.where(F.col("kind") == ROW).groupBy("conv_id", "role", "code").agg(first)
    firsts = firsts.select("conv_id", "turn", "role", F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(FIRST).alias("kind"), "code")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, most_nodes long"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size, kind = None, [], 0, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text, n, what, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "kind", "code")), strict=True):
                if now is None or conv != now.key:
                    if now is not None:
                        out.append(now.result())
                        size += len(out[-1][7])
                    now = Conversation(conv)
                if what == FIRST:
                    now.fresh = code
                elif what == ROW:
                    now.add(turn, role, text, code, n)
            if len(out) > 1000 or size > 1 << 20:
                yield _batch(out, names, kind)
                out, size = [], 0
        if now is not None:
            out.append(now.result())
        if out:
            yield _batch(out, names, kind)

    return in_order(coded, firsts).mapInArrow(run, schema)


def _batch(rows: list, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    text = ("audit", "repaired_sha256", "role", "text")
    kinds = [kind if c == "conv_id" else pa.string() if c in text else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired conversations, from the edits found: each conversation's
    edits come before its rows in the stream, which applies them row by row."""
    coded = _coded(rows).where(F.col("kind") == ROW)
    first = found.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("n"), F.lit(FIRST).alias("kind"), F.lit(None).cast("binary").alias("code"))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        audit, at, place, state, conv = "", 0, 0, NONE, None

        def write(role: str, text: str, to: int) -> None:
            nonlocal place, state
            out.append((conv, place, role, text))
            place, state = place + 1, to

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                to = ASSISTANT if state == USER else USER
                write(ROLES[to], "", to)
                at += 1

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text, n, what in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "kind")), strict=True):
                if what == FIRST:
                    audit, at, place, state = text, 0, 0, NONE
                    inserted()
                    continue
                for _ in range(n):
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        write(role, text, STEPS[state, role[:1]])
                    elif edit == "R":
                        to = ASSISTANT if state == USER else USER
                        write(ROLES[to], text, to)
                    inserted()
            if out:
                yield _batch(out, ["conv_id", "place", "role", "text"], kind)
                out = []

    return in_order(coded, first).mapInArrow(run, schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(damaged(table(spark, sf_dir, "conversations")))
