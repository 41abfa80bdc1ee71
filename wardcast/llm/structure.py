"""Repair of conversations: the cheapest edits after which turns alternate, found by iterative-deepening A*.

A repaired conversation has roles with the initials ``(s?(ua)+)?``. Edits, in the order of their letters: D deletes a turn (3; the only one
for blank and duplicate turns), I inserts an empty turn of user or assistant (2), K keeps a turn, R gives it the role user or assistant (2). A
truncated turn that stays adds 1. Of equally cheap repairs the one whose letters come first in ASCII order is taken.

1. Faults need no order but the turn's: duplicates come from the first turn of each (role, text), by an aggregation that is combined map-side.
2. Rows without their texts are range-partitioned by (conversation, turn, key of the row) and read in order. A conversation that lies within one task and
   has at most ``CHUNK`` turns is searched as a whole. Longer ones are cut into chunks; of each, the searches give the cheapest, then
   ASCII-first, letters between every state at its start and every state at its end, so one conversation's work is spread over tasks.
3. Per conversation, chunks are put together in order (four partial repairs, one per state), and its texts, which follow in the same stream in the order of
   turns, are hashed as the letters say. Nothing of a conversation is held but its letters, which are a part of the result.

A search knows a state by (turn, last role). Depth first, edits in ASCII order, within a bound on cost plus a lower bound of what is
left; the bound rises to the least sum that exceeded it. States that failed with some cost to spend are not entered again with as much or less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardcast.llm.text import bounded_batches

CHUNK = 256
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Last role: none, system, user, assistant. Which state a role's initial leads to, and which states it may follow.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after the user or assistant turn that fits, for inserts and changed roles.
FITTING = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = ("su", "ua", "au")
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that complete a conversation.
CLOSING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Codes of a turn: its initial, upper case if truncated; DROP if it must be deleted.
DROP = "-"


def lower_bounds(codes: str) -> list[int]:
    """For each place, a cost that all repairs of the turns from there on have at least.

    Forced deletes and truncated turns cost what they cost, or 1. Of neighbours that remain, each illegal pair needs an edit, and an edit
    mends at most two pairs.
    """
    out, forced, pairs, after = [0], 0, 0, ""
    for code in reversed(codes):
        if code == DROP:
            forced += DELETE
        else:
            forced += TRUNCATED if code.isupper() else 0
            pairs += bool(after) and code.lower() + after not in LEGAL
            after = code.lower()
        out.append(forced + 2 * ((pairs + 1) // 2))
    return out[::-1]


def search(codes: str, entry: int = NONE, exits: tuple[int, ...] | None = None) -> tuple[int, str]:
    """The cheapest, then ASCII-first, edits of turns from a state, as cost and letters.

    Without ``exits`` the repair is to be complete, inserts after the last turn included. Otherwise it ends with the last turn, in one of the
    given states, which must be reachable.
    """
    n, bounds = len(codes), lower_bounds(codes)
    #: What a state that failed needs at least.
    needs: dict[tuple[int, int], int] = {}

    def edits(place: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, place, state) in ASCII order."""
        code = codes[place] if place < n else None
        if code is not None:
            yield "D", DELETE, place + 1, state
        if code is not None or exits is None:
            yield "I", INSERT, place, FITTING[state]
        if code is not None and code != DROP:
            extra = TRUNCATED if code.isupper() else 0
            kept = NEXT.get((state, code.lower()))
            if kept is not None:
                yield "K", extra, place + 1, kept
            yield "R", REROLE + extra, place + 1, FITTING[state]

    bound = bounds[0]
    while True:
        # One entry per edit made: place, state, cost left, edits to try, least need of those that failed, letter and cost of the edit.
        stack = [[0, entry, bound, edits(0, entry), float("inf"), "", 0]]
        while stack:
            place, state, left, more, need, _, spent = top = stack[-1]
            if place == n and (state in (NONE, ASSISTANT) if exits is None else state in exits):
                return bound - left, "".join(x[5] for x in stack)
            step = next(more, None)
            if step is None:
                needs[place, state] = max(needs.get((place, state), 0), need)
                stack.pop()
                if stack:
                    stack[-1][4] = min(stack[-1][4], need + spent)
                continue
            letter, cost, place, state = step
            least = max(bounds[place], needs.get((place, state), 0))
            if least > left - cost:
                top[4] = min(need, cost + least)
            else:
                stack.append([place, state, left - cost, edits(place, state), float("inf"), letter, cost])
        bound = needs[0, entry]


def matrix(codes: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, letters) for all states between which a chunk can be edited."""
    ends = {NONE: [NONE, USER, ASSISTANT], SYSTEM: [SYSTEM, USER, ASSISTANT], USER: [USER, ASSISTANT], ASSISTANT: [USER, ASSISTANT]}
    if "s" in codes.lower():
        ends[NONE].append(SYSTEM)
    return [(entry, end, *search(codes, entry, (end,))) for entry in ends for end in ends[entry]]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of ``conv_id:turn`` brings: conv_id, turn, role, text, copies. Nulls in role, text and the hashed text are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return rows.where(kind != 0).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(part("role")).alias("role"),
                                        text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def row_key() -> Column:
    """32 bytes that stand for role and text, and order the rows of one turn."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, key, initial, fault (of the first copy), copies: one row per different row of a conversation.

    ``rows`` has conv_id, turn, role, text and copies. Copies of a row are counted before the shuffle; all but the first row, by turn (nulls first), of a role and
    text are duplicates.
    """
    last = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~last.isin(".", "!", "?"), "truncated")
    lean = rows.select("conv_id", "turn", row_key().alias("key"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")
    once = lean.groupBy("conv_id", "turn", "key", "initial", "fault").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = once.groupBy("conv_id", "key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    both = once.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    later = F.coalesce(F.col("first") < at, F.lit(False))
    return both.select("conv_id", "turn", "key", "initial", F.when((F.col("fault") == "blank"), "blank").when(later, "duplicate").otherwise(F.col("fault")).alias("fault"), "copies")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECE = "conv_id {id}, part int, chunk int, whole boolean, repairs array<struct<entry:int,exit:int,cost:bigint,letters:string>>, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", first string, last string"


def pieces(rows: DataFrame, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Repairs of chunks of conversations, from the rows of ``turns``."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key")]
    ranges = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType
    schema = PIECE.format(id=kind.simpleString())

    repairs = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
    kinds = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.bool_(), repairs, *[pa.int64()] * 4, pa.string(), pa.string()]
    names = ["conv_id", "part", "chunk", "whole", "repairs", *COUNTS, "first", "last"]

    def solved(conv, part: int, number: int, held: list[tuple[str, str | None]], whole: bool) -> tuple:
        codes = "".join(_code(*turn) for turn in held)
        found = [(NONE, ASSISTANT, *search(codes))] if whole else matrix(codes)
        initials, faults = [i for i, _ in held], [f for _, f in held]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return (conv, part, number, whole, [dict(zip(("entry", "exit", "cost", "letters"), x)) for x in found], *(faults.count(c) for c in COUNTS[:3]), illegal, initials[0], initials[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple[str, str | None]] = []  # initial and fault of turns not yet searched
        now, part, number, edge = None, 0, 0, True  # edge: the conversation may have begun in an earlier task
        for batch in batches:
            for conv, initial, fault, copies, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "copies", "part"))):
                if held and conv != now:
                    out.append(solved(now, part, number, held, not edge and not number))
                    held, number, edge = [], 0, False
                now = conv
                for k in range(copies):
                    if len(held) == chunk:
                        out.append(solved(now, part, number, held, False))
                        held, number = [], number + 1
                    held.append((initial, fault if not k or fault == "blank" else "duplicate"))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if held:  # may go on in the next task
            yield pa.record_batch([pa.array([v], k) for v, k in zip(solved(now, part, number, held, False), kinds)], names=names)

    return ranges.withColumn("part", F.spark_partition_id()).mapInArrow(run, schema)


def _code(initial: str, fault: str | None) -> str:
    """One letter for a turn: its initial, x for one that fits nowhere, upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return DROP
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


class Partial:
    """The best repairs up to some turn, one per state: cost, place among the others in ASCII order, and letters as a chain of chunks."""

    def __init__(self):
        self.states: dict[int, tuple[int, int, tuple]] = {NONE: (0, 0, ())}

    def add(self, repairs: list[dict]) -> None:
        """One more chunk. Letters up to one turn never begin others up to it, so two repairs are in the order of their first chunks that differ."""
        found = {}
        for r in repairs:
            if r["entry"] in self.states:
                cost, place, done = self.states[r["entry"]]
                value = (cost + r["cost"], place, r["letters"], done)
                if r["exit"] not in found or value[:3] < found[r["exit"]][:3]:
                    found[r["exit"]] = value
        order = sorted((v[1:3], state) for state, v in found.items())
        self.states = {state: (found[state][0], i, (found[state][3], found[state][2])) for i, (_, state) in enumerate(order)}

    def complete(self) -> tuple[int, str]:
        """Cost and letters of the best complete repair."""
        cost, _, state = min((c + INSERT * len(CLOSING[s]), place, s) for s, (c, place, _) in self.states.items())
        out, chain = [CLOSING[state]], self.states[state][2]
        while chain:
            chain, part = chain
            out.append(part)
        return cost, "".join(reversed(out))


def repaired(conversations: DataFrame, rows: DataFrame | None = None, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """Per conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' letters) and repaired_sha256.

    ``rows`` are the rows to repair (conv_id, turn, role, text, copies), by default the table's own with nulls as one space. A null conv_id is a conversation of
    its own, a null turn comes first, rows of one turn are ordered by a hash of role and text, repeated rows are duplicates. A
    conversation without rows has zeros, an empty audit and the hash of an empty text; an empty table gives an empty result. Roles that start
    with other letters fit nowhere unless changed. Other columns are ignored. ``audit`` is one string per conversation, which bounds its turns to 2^31.
    """
    if rows is None:
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"), F.lit(1).cast("bigint").alias("copies"))
    lean = turns(rows)
    # distinct turns first, so that one conversation's are counted in many tasks
    spans = lean.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = pieces(lean, chunk, parts)
    empty = lambda kind: F.lit(None).cast(kind)
    head = ["conv_id", "kind", "a", "b", "key", "piece", "role", "text", "copies"]
    piece = F.struct("whole", "repairs", *COUNTS, "first", "last")
    numbered = found.select("conv_id", F.lit(0).alias("kind"), F.col("part").cast("bigint").alias("a"), F.col("chunk").alias("b"), empty("binary").alias("key"),
                            piece.alias("piece"), empty("string").alias("role"), empty("string").alias("text"), empty("bigint").alias("copies"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").alias("a"), F.lit(0).alias("b"), row_key().alias("key"), empty(numbered.schema["piece"].dataType).alias("piece"), "role", "text", "copies")
    stream = numbered.select(head).unionByName(texts.select(head)).repartition("conv_id")
    stream = stream.sortWithinPartitions("conv_id", "kind", F.col("a").asc_nulls_first(), "b", "key")
    kind = conversations.schema["conv_id"].dataType
    ids = conversations.select("conv_id").distinct()
    done = _told(bounded_batches(stream), kind)
    out = ids.select(F.col("conv_id").alias("id"))
    same = lambda other: F.col("id").eqNullSafe(other["conv_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    full = out.join(done, same(done), "left").drop("conv_id").join(spans, same(spans), "left")
    return full.select(F.col("id").alias("conv_id"), zero("gaps"), *(zero(c) for c in COUNTS), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _told(stream: DataFrame, kind) -> DataFrame:
    """Reads each conversation's pieces and then its texts, in order: conv_id, counts, cost, audit, repaired_sha256."""
    names = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    schema = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", cost bigint, audit string, repaired_sha256 string"
    arrow = [to_arrow_type(kind), *[pa.int64()] * 5, pa.string(), pa.string()]

    class Told:
        """One conversation."""

        def __init__(self, conv):
            self.conv, self.counts, self.last, self.partial, self.begun = conv, dict.fromkeys(COUNTS, 0), None, Partial(), False
            self.repair: tuple[int, str] | None = None

        def add(self, piece: dict) -> None:
            for c in COUNTS:
                self.counts[c] += piece[c]
            if self.last is not None:
                self.counts["illegal"] += self.last + piece["first"] not in LEGAL
            self.last = piece["last"]
            if piece["whole"]:
                self.repair = (piece["repairs"][0]["cost"], piece["repairs"][0]["letters"])
            else:
                self.partial.add(piece["repairs"])

        def start(self) -> None:
            """Choose the repair; the texts come next."""
            self.cost, self.audit = self.repair or self.partial.complete()
            self.place, self.state, self.sha, self.any = 0, NONE, hashlib.sha256(), False

        def emit(self, role: str, text: str) -> None:
            self.sha.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
            self.any = True

        def text(self, role: str, text: str, copies: int) -> None:
            if not self.begun:
                self.start()
                self.begun = True
            for _ in range(copies):
                self.inserts()
                letter = self.audit[self.place]
                self.place += 1
                if letter == "D":
                    continue
                self.state = NEXT[self.state, role[:1]] if letter == "K" else FITTING[self.state]
                self.emit(role if letter == "K" else ROLES[self.state], text)

        def inserts(self) -> None:
            while self.place < len(self.audit) and self.audit[self.place] == "I":
                self.state = FITTING[self.state]
                self.emit(ROLES[self.state], "")
                self.place += 1

        def end(self) -> tuple:
            self.inserts()
            return (self.conv, *self.counts.values(), self.cost, self.audit, self.sha.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for conv, kind_, piece, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "piece", "role", "text", "copies"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.end())
                    now = Told(conv)
                if kind_ == 0:
                    now.add(piece)
                else:
                    now.text(role, text, copies)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), arrow)], names=names)
        if now is not None:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(now.end(), arrow)], names=names)

    return stream.mapInArrow(run, schema)
