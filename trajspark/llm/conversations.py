"""Repair of the turn structure of conversations by depth-first branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import parts, small_batches

WHITE = " \t\n\x0b\f\r"
#: Rows that one search covers; longer conversations are put together from searches over chunks.
CHUNK = 128
#: Roles so far: none, a system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state a kept role leads to from each state, and the one a rewritten or inserted turn leads to.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What must still be inserted at the end of a conversation.
TAIL = {START: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}
LEGAL = frozenset(("su", "ua", "au"))
GONE = "x"
LONG = 2**63 - 1
#: Order of a conversation's rows; rows with the same turn, role and text are told apart by nothing.
ORDER = ["turn", "role", "head", "h"]


def bounds(codes: str) -> tuple[list[int], list[int], list[int]]:
    """For every suffix of ``codes``: what its rows cost at least by themselves, its first row that may stay (or the length), and how many
    rows and disjoint pairs of neighbours it has that cannot stay as they are.

    A row of another role, and two neighbours whose roles do not follow one another, need an edit of their own (cost 2 or more beyond what the
    rows cost anyway): of one of both, or an insertion between.
    """
    n = len(codes)
    base, first, pairs = [0] * (n + 1), [n] * (n + 2), [0] * (n + 2)
    for i in range(n - 1, -1, -1):
        c = codes[i]
        if c == GONE:
            base[i], first[i], pairs[i] = base[i + 1] + 3, first[i + 1], pairs[i + 1]
            continue
        base[i], first[i] = base[i + 1] + c.isupper(), i
        after = first[i + 1]
        if c in "oO":
            pairs[i] = 1 + pairs[after]
        elif after == n or codes[after] in "oO":
            pairs[i] = pairs[after]
        else:
            pairs[i] = max(pairs[after], ((c + codes[after]).lower() not in LEGAL) + pairs[first[after + 1]])
    return base, first, pairs


@lru_cache(1 << 14)
def repairs(codes: str, entry: int) -> tuple[tuple[int, int, str], ...]:
    """(exit state, cost, audit) of the cheapest edits of a chunk for every exit state that can be reached from ``entry``.

    ``codes`` has a letter per row: x where it must go, else s, u, a or o by its role, upper case if its text is cut off. Depth-first search
    with an explicit stack. A prefix is left if its cost and the bound of its suffix exceed the incumbent (or tie with it and sort behind), or
    if the table of its node (row, state) has a prefix that is no dearer and sorts no later: what follows depends on the node alone, and two
    prefixes of a node never begin one another, since insertions come before a row only. When the stack is empty the incumbent is optimal.
    """
    n = len(codes)
    base, first, pairs = bounds(codes)
    low = codes.lower()

    def bound(i: int, state: int) -> int:
        f = first[i]
        if f == n or low[f] == "o":
            return base[i] + 2 * pairs[f]
        clash = low[f] not in KEEP[state]
        return base[i] + 2 * max(pairs[f], clash + pairs[first[f + 1]])

    out = []
    for goal in (START, SYSTEM, USER, ASSISTANT):
        if goal < entry and goal in (START, SYSTEM):
            continue
        incumbent: tuple[int, str] | None = None
        table: dict[tuple[int, int], tuple[int, str]] = {}
        stack = [(0, entry, 0, "")]
        while stack:
            i, state, cost, audit = stack.pop()
            known = table.get((i, state))
            if known is not None and known <= (cost, audit):
                continue
            if incumbent is not None:
                least = cost + bound(i, state)
                if least > incumbent[0] or least == incumbent[0] and audit > incumbent[1][:len(audit)]:
                    continue
            table[i, state] = cost, audit
            if i == n:
                if state == goal and (incumbent is None or (cost, audit) < incumbent):
                    incumbent = cost, audit
                continue
            c = low[i]
            after = NEXT[state]
            moves = [(i + 1, state, cost + 3, audit + "D")]
            if c != GONE:
                cut = codes[i] != c
                if c in KEEP[state]:
                    moves.append((i + 1, KEEP[state][c], cost + cut, audit + "K"))
                moves.append((i + 1, after, cost + cut + 2, audit + "R"))
                moves.append((i, after, cost + 2, audit + "I"))
            if goal in (START, SYSTEM):  # a user or assistant turn is never undone
                moves = [m for m in moves if m[1] <= goal]
            moves.sort(key=lambda m: (m[2] + bound(m[0], m[1]), m[3]), reverse=True)
            stack += moves
        if incumbent is not None:
            out.append((goal, *incumbent))
    return tuple(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) mod 20: 0 drops the row, 1 empties its text, 2 takes
    its full stops, 3 repeats it, 4 makes its role user. Nulls count as one space, but a null turn stays null.

    Columns conv_id, turn, role, text and copies (0 for a dropped row, which still says that there is such a conversation).
    """
    at = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
                                (F.crc32(at) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("_k") == 0, 0).when(F.col("_k") == 3, 2).otherwise(1).alias("copies"))


def _rows(rows: DataFrame) -> DataFrame:
    """Rows with the columns that order them. ``conv`` is never null: a space stands for no conv_id."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], copies.alias("copies"))
    there = F.col("copies") > 0
    return plain.select("conv", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, F.col("text")).alias("text"), "copies",
                        F.when(there, F.substring("text", 1, 64)).alias("head"), F.when(there, F.unhex(F.sha2("text", 256))).alias("h"))


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation as one with their number, what is wrong with their text, and whether it is the first with this role and text.

    Only digests of texts are shuffled. The first turn of a text is joined, not taken from a window, so a text that fills a conversation is
    combined before the shuffle.
    """
    solid = F.rtrim("text", F.lit(WHITE))
    one = rows.select("conv", "turn", "role", "head", "h", "copies", (solid == "").alias("blank"), F.substring(solid, -1, 1).isin(".", "!", "?").alias("ended"))
    one = one.groupBy("conv", "turn", "role", "h").agg(F.sum("copies").alias("m"), *[F.first(c).alias(c) for c in ("head", "blank", "ended")])
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    first = one.where("m > 0").groupBy("conv", "role", "h").agg(F.min(at).alias("f"))
    return one.join(first, ["conv", "role", "h"], "left").select(
        "conv", *ORDER, F.substring("role", 1, 1).alias("initial"), "m", "blank", "ended", F.col("f").eqNullSafe(at).alias("new"))


class _Chunk:
    """Consecutive rows of a conversation: their codes and what they count."""

    def __init__(self, conv: str, number: int, whole: bool):
        self.conv, self.number, self.whole = conv, number, whole  # whole: the conversation begins here
        self.codes: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, blank: bool, ended: bool, new: bool) -> None:
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        if blank or not new:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            self.codes.append(GONE)
        else:
            self.truncated += not ended
            c = initial if initial in ("s", "u", "a") else "o"
            self.codes.append(c if ended else c.upper())

    def row(self, part: int) -> tuple:
        codes = "".join(self.codes)
        found = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in ((START,) if self.whole else range(4)) for x, c, a in repairs(codes, e)]
        return (self.conv, part, self.number, found, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first, self.last, self.low, self.high)


FOUND = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
CHUNKS = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("found", FOUND), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
                    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PLANS = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])
DIGESTS = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _spark(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema
    return from_arrow_schema(schema).simpleString()[len("struct<"):-1]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the conversations of a range of sorted rows."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        chunk = None
        for b in batches:
            for conv, turn, initial, m, blank, ended, new in zip(*[b.column(c).to_pylist() for c in ("conv", "turn", "initial", "m", "blank", "ended", "new")]):
                if chunk is None or chunk.conv != conv:
                    if chunk is not None:
                        yield chunk.row(part)
                    chunk = _Chunk(conv, 0, chunk is not None)  # the first conversation of a range may have begun in the one before
                for k in range(m):
                    if len(chunk.codes) == CHUNK:
                        yield chunk.row(part)
                        chunk = _Chunk(conv, chunk.number + 1, False)
                    chunk.add(turn, initial, blank, ended, new and not k)
        if chunk is not None:
            yield chunk.row(part)

    return _batches(rows(), CHUNKS)


class _Conversation:
    """Chunks put together: per state the cheapest edits so far, of which only what differs is kept beside their common beginning."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last = self.low = self.high = None
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}
        self.common: list[str] = []

    def add(self, c: dict) -> None:
        for k in self.counts:
            self.counts[k] += c[k]
        if c["first"] is not None:
            self.counts["illegal"] += self.last is not None and self.last + c["first"] not in LEGAL
            self.last = c["last"]
        if c["low"] is not None:
            self.counts["turns"] -= self.high == c["low"]
            self.low, self.high = c["low"] if self.low is None else self.low, c["high"]
        now: dict[int, tuple[int, str]] = {}
        for f in c["found"]:
            if f["entry"] in self.best:
                cost, audit = self.best[f["entry"]]
                option = cost + f["cost"], audit + f["audit"]
                if f["exit"] not in now or option < now[f["exit"]]:
                    now[f["exit"]] = option
        shared = commonprefix([a for _, a in now.values()])
        self.common.append(shared)
        self.best = {s: (cost, a[len(shared):]) for s, (cost, a) in now.items()}

    def row(self, conv: str) -> tuple:
        cost, audit = min((cost + TAIL[s][0], a + TAIL[s][1]) for s, (cost, a) in self.best.items())
        gaps = min(self.high - self.low + 1 - self.counts["turns"], LONG) if self.low is not None else 0
        return (conv, gaps, *[self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")], cost, "".join(self.common) + audit)


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of the conversations whose chunks come in order."""
    def rows() -> Iterator[tuple]:
        at, one = None, None
        for b in batches:
            for c in b.to_pylist():
                if c["conv"] != at:
                    if one is not None:
                        yield one.row(at)
                    at, one = c["conv"], _Conversation()
                one.add(c)
        if one is not None:
            yield one.row(at)

    return _batches(rows(), PLANS)


def _plans(rows: DataFrame) -> DataFrame:
    n = parts(rows.sparkSession)
    ordered = _faults(rows).repartitionByRange(n, "conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    chunks = ordered.select("conv", "turn", "initial", "m", "blank", "ended", "new").mapInArrow(_chunked, _spark(CHUNKS))
    return chunks.repartition(n, "conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_planned, _spark(PLANS))


def _conv_id() -> F.Column:
    return F.expr("try_cast(conv AS BIGINT)").alias("conv_id")


def repair_plans(conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Rows count by turn, nulls first, then role and text. The audit has a letter for each edit in order: Keep, Rerole to user or assistant (2),
    Delete (3, for every blank or repeated row), Insert an empty user or assistant turn (2); a row that stays though its text is cut off
    adds 1. Roles then begin as ``(s?(ua)+)?``; of equal costs the least audit by ASCII is taken.

    Rows are sorted by ranges, so one conversation may lie in many tasks; each searches its chunks for every state they may be entered in, and
    a row per chunk is put together. Null role or text is one space; null conv_id is a conversation; gaps are at most 2**63 - 1. Repeated rows
    are duplicates, extra columns are ignored (but ``copies``, how often a row stands there); an empty table gives an empty result.
    """
    small_batches(conversations.sparkSession)
    return _plans(_rows(conversations)).select(_conv_id(), *COUNTS, "audit")


def edited(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation after the edits of an audit."""
    state, source = START, iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield ROLES[state], ""
            continue
        role, text = next(source)
        if edit == "K":
            state = KEEP[state][role[:1]]
            yield role, text
        elif edit == "R":
            state = NEXT[state]
            yield ROLES[state], text


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Per conversation its plan and, to be read before the next one, its rows. A plan comes before its rows."""
    stream = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    ahead = next(stream, None)

    def rows(conv: str) -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            role, text, copies = ahead[3:6]
            for _ in range(copies):
                yield role, text
            ahead = next(stream, None)

    while ahead is not None:
        plan, ahead = ahead, next(stream, None)
        own = rows(plan[0])
        yield (plan[0], *plan[6:]), own
        for _ in own:
            pass


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for plan, turns in _streamed(batches):
            digest, between = sha256(), b""
            for role, text in edited(turns, plan[-1]):
                digest.update(between + role.encode() + b":" + text.encode())
                between = b"\n"
            yield (*plan, digest.hexdigest())
    return _batches(rows(), DIGESTS)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for plan, turns in _streamed(batches):
            for k, (role, text) in enumerate(edited(turns, plan[-1])):
                yield plan[0], k, role, text
    return _batches(rows(), TURNS, 256)


TURNS = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _with_plans(conversations: DataFrame) -> DataFrame:
    """Plans and rows of each conversation together, a plan first. A conversation's text is read once, in order, and never held."""
    rows = _rows(conversations)
    empty = {"turn": "long", "role": "string", "text": "string", "copies": "long", "head": "string", "h": "binary"}
    plans = _plans(rows).select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], *COUNTS, "audit")
    texts = rows.where("copies > 0").select("conv", F.lit(1).alias("kind"), *empty, *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"))
    both = plans.union(texts).repartition(parts(rows.sparkSession), "conv").sortWithinPartitions("conv", "kind", *ORDER)
    return both.select("conv", "kind", "turn", "role", "text", "copies", *COUNTS, "audit")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role, text; see :func:`repair_plans`. Conversations of which nothing is left have no rows."""
    small_batches(conversations.sparkSession)
    return _with_plans(conversations).mapInArrow(_written, _spark(TURNS)).select(_conv_id(), "turn", "role", "text")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """:func:`repair_plans` of all conversations after :func:`damaged`, with repaired_sha256 of the repaired ``role:text`` lines.

    A conversation without rows after the damage has zeros, an empty audit and the hash of the empty string. SHA-256 of a conversation is one
    chain, so one task reads its rows in order, a batch at a time.
    """
    small_batches(conversations.sparkSession)
    return _with_plans(damaged(conversations)).mapInArrow(_hashed, _spark(DIGESTS)).select(_conv_id(), *COUNTS, "audit", "repaired_sha256")
