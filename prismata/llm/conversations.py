"""Conversation repair by a lazily determinised weighted automaton.

Rows are edited so that the role initials of a conversation read `(s?(ua)+)?`: keep (0),
give the role user or assistant (1), delete (2), insert an empty row (5); a truncated row
that stays costs 5 more, blank rows and repeats must go. As an automaton this has four
states (start, after s, after u, after a) and weighted arcs, insertions being arcs that
read nothing.

It is determinised as rows arrive. A state of the deterministic automaton is the vector of
costs of the four states, its least value subtracted. From the end of a conversation to
its beginning such a vector holds the cost that is left to the end. The transition table
keeps, for a vector and the kind of the row read, the next vector, what was subtracted,
and the first tight arc of each state in the order of the audit's letters; only vectors
that occur are ever made, and a worker shares them among all its conversations. The scan
from the last row to the first is one look-up a row and gives the cost; the trace back
along tight arcs, another look-up a row, gives the audit.

The work is dealt out so: built-in expressions mark the faults of rows; repeats come from
an aggregate by conversation and digest and a join on its unique rows; then digests (no
texts) are sorted by conversation and scanned, one byte a row being held, as many as the
audit has; last, the texts are sorted and stream through the hash, no more than one Arrow
batch at a time. A long conversation thus never lies in memory as a whole.

Defined results: a null role or text counts as one space. Null ids are one conversation.
Rows of one turn come by role, then by the MD5 of their text; null turns first. The
initial of an empty role is empty and reads nothing. Equal rows are repeats of each other.
A conversation without rows costs nothing and has an empty audit. An empty table gives no
rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, lean

START, S, U, A = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: Where an insertion or a new role leads: the one role other than system that may follow.
FORCED = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
FINAL = (START, A)
#: Kinds of rows: the initial (s, u, a, another, none) and whether the row is truncated; one kind must go.
INITIALS = ("s", "u", "a", "x", "")
GONE = 2 * len(INITIALS)
FAR = 1 << 40


def _inserted(cost: list[int]) -> list[int]:
    """Costs with insertions; two at most are of use."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[FORCED[q]]) for q, c in enumerate(cost)]
    return cost


def _arcs(q: int, kind: int) -> list[tuple[str, int, int]]:
    """(letter, weight, state after) of the arcs that read a row of a kind, by letter."""
    out = [("D", DELETE, q)]
    if kind == GONE:
        return out
    initial, cut = INITIALS[kind // 2], CUT * (kind % 2)
    to = q if not initial else NEXT.get((q, initial))
    if to is not None:
        out.append(("K", KEEP + cut, to))
    out.append(("R", REROLE + cut, FORCED[q]))
    return out


class Lazy:
    """The deterministic automaton as far as it was needed: vectors, transitions, tight arcs."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int, tuple]] = {}
        self.last, _ = self._id(_inserted([0 if q in FINAL else FAR for q in range(4)]))

    def _id(self, cost: list[int]) -> tuple[int, int]:
        low = min(cost)
        vector = tuple(c - low for c in cost)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], low

    def step(self, state: int, kind: int) -> tuple[int, int, tuple]:
        """(state before the row, what was subtracted, the audit's arc of each of the four states)."""
        if (have := self.table.get((state, kind))) is None:
            after = self.vectors[state]
            cost = _inserted([min(w + after[to] for _, w, to in _arcs(q, kind)) for q in range(4)])
            before, low = self._id(cost)
            arcs = []
            for q in range(4):
                tight = [(letter, to, True) for letter, w, to in _arcs(q, kind) if cost[q] == w + after[to]]
                if cost[q] == INSERT + cost[FORCED[q]]:
                    tight.append(("I", FORCED[q], False))
                arcs.append(min(tight))
            have = self.table[state, kind] = (before, low, tuple(arcs))
        return have

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """(cost, audit) of the rows of these kinds."""
        state, total, passed = self.last, 0, []
        for kind in reversed(kinds):
            passed.append(step := self.step(state, kind))
            state, total = step[0], total + step[1]
        total += self.vectors[state][START]
        letters, q = [], START
        for step in reversed(passed):
            read = False
            while not read:
                letter, q, read = step[2][q]
                letters.append(letter)
        while q not in FINAL:
            letters.append("I")
            q = FORCED[q]
        return total, "".join(letters)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the times the row stands there; 0 where it is dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(dealt == 1, "").when(dealt == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(dealt == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1).alias("n"))


def _turns() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def marked(rows: DataFrame) -> DataFrame:
    """Adds `digest` of the text, `blank` and `cut` (the last character ends no sentence)."""
    inner = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return rows.withColumns({"digest": F.md5(F.col("text").cast("binary")), "blank": inner == "", "cut": ~F.substring(inner, -1, 1).isin(".", "!", "?")})


def _distinct(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, with `first`: none before it has its role and text."""
    one = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    least = one.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(order).getField("turn").alias("turn"))
    least = least.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "role", "digest")])
    # by all four columns: no key of this join has more than one row on a side
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in ("conv_id", "turn") else F.col(c) == F.col(f"_{c}") for c in ("conv_id", "turn", "role", "digest")]
    on = equal[0] & equal[1] & equal[2] & equal[3]
    return one.join(least, on, "left").withColumn("first", F.col("_digest").isNotNull()).drop("_conv_id", "_turn", "_role", "_digest")


def _audits(kind: pa.DataType):
    """Rows (conv_id, turn, initial, n, blank, cut, first), sorted -> one row a conversation."""
    fields = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = pa.schema([("conv_id", kind), *[(f, pa.int64()) for f in fields[1:-1]], ("audit", pa.string())])
    nothing = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lazy, conv, out = Lazy(), nothing, []
        kinds, known, blank, twice, cuts, illegal, initial, low, high, turn = bytearray(), 0, 0, 0, 0, 0, None, None, None, None

        def done() -> dict:
            cost, audit = lazy.repair(bytes(kinds))
            gaps = high - low + 1 - known if known else 0
            return dict(zip(fields, (conv, gaps, blank, twice, cuts, illegal, cost, audit)))

        for batch in batches:
            for c, t, i, n, b, u, first in zip(*[x.to_pylist() for x in batch.columns]):
                if c != conv or conv is nothing:
                    if conv is not nothing:
                        out.append(done())
                    conv, kinds = c, bytearray()
                    known, blank, twice, cuts, illegal, initial, low, high, turn = 0, 0, 0, 0, 0, None, None, None, None
                if not n:
                    continue
                if t is not None and t != turn:
                    known, turn, high = known + 1, t, t
                    low = t if low is None else low
                illegal += (initial is not None and initial + i not in ("su", "ua", "au")) + n - 1
                initial = i
                # of equal rows the first may stay, unless it is blank or came before
                stays = first and not b
                if b:
                    blank += n
                else:
                    twice += n - stays
                    cuts += stays and u
                if stays:
                    kinds.append(2 * (INITIALS.index(i) if i in INITIALS else 3) + u)
                kinds.extend(bytes([GONE]) * (n - stays))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if conv is not nothing:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _hashes(kind: pa.DataType):
    """Each conversation's audit row, then its rows (role, text, n) in order -> the audit row with its hash."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = pa.schema([("conv_id", kind), *[(f, pa.int64()) for f in names[1:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, at, q, empty, out = None, None, 0, START, True, []

        def put(role: str, text: str) -> None:
            nonlocal empty
            digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            empty = False

        def insertions() -> None:
            nonlocal at, q
            while head["audit"][at : at + 1] == "I":
                at, q = at + 1, FORCED[q]
                put(ROLE[q], "")

        def done() -> dict:
            insertions()
            return head | {"repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for i, (audit, role, text, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("audit", "role", "text", "n")])):
                if audit is not None:
                    if head is not None:
                        out.append(done())
                    head, digest, at, q, empty = {c: batch.column(c)[i].as_py() for c in names}, hashlib.sha256(), 0, START, True
                    continue
                for _ in range(n):
                    insertions()
                    letter, at = head["audit"][at], at + 1
                    if letter == "K":
                        q = NEXT[q, role[0]] if role else q
                        put(role, text)
                    elif letter == "R":
                        q = FORCED[q]
                        put(ROLE[q], text)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if head is not None:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def audited(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: as damaged() gives them, marked. Rows with n = 0 stand for their conversation only.
    """
    kind = rows.schema["conv_id"].dataType
    own = _distinct(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_turns())
    own = own.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "blank", "cut", "first")
    counts = ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return own.mapInArrow(lean(_audits(_arrow(kind))), f"conv_id {kind.simpleString()}, {counts}, audit string")


def repaired(rows: DataFrame) -> DataFrame:
    """audited() with the SHA-256 of each repaired conversation; rows: conv_id, turn, role, text, n."""
    bound_batches(rows.sparkSession)
    rows = marked(rows)
    audits = checkpointed(audited(rows))
    heads = audits.withColumn("_row", F.lit(0))
    texts = rows.where("n > 0").select("conv_id", "turn", "role", "text", "n", "digest", F.lit(1).alias("_row"))
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "_row", *_turns())
    return both.drop("_row", "digest", "turn").mapInArrow(lean(_hashes(_arrow(rows.schema["conv_id"].dataType))), f"{audits._jdf.schema().toDDL()}, repaired_sha256 string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
