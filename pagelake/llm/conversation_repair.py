"""Conversation structure repair by depth-first branch and bound.

Rows of a conversation stand in the order of turn (nulls first), then role and text. Each has at most one fault, the
first that holds: blank (nothing but blanks), duplicate (role and text stand earlier), truncated (the last
character that is no blank does not end a sentence). Roles must read, by their initials, (s?(ua)+)?. Keeping a row
costs 0, giving it the role user or assistant 2, deleting it 3 (blank and duplicate rows must go), an inserted empty
row 2; a truncated row that stays costs 1 more. The cheapest edits are sought, of equally cheap ones those whose initials
(D, I, K, R) are least as a string.

The search keeps an explicit stack of prefixes (rows read, state of the roles, cost, audit). A prefix is left when its cost
and a lower bound of the rest (the same edits with system rows allowed anywhere) exceed the incumbent, when it
can at best tie with it but its audit is greater, or when the dominance table of its node holds a prefix that is no worse.
When the stack is empty, the incumbent is proved.

No conversation need fit a task: rows are sorted by ranges of (conversation, turn, role). Conversations inside one range
and no longer than ``SEGMENT`` rows are solved there. Others are cut into segments; each is searched for all pairs of states
at its ends, and the segments are folded in order, with one audit and one running digest per state. Rows that
stand earlier are found by aggregates of (conversation, role, digest of the text), so no list of a conversation's rows is kept.

A null role or text is one blank, a null conversation is one of its own, null turns come first and do not count for gaps.
Rows equal in turn, role and text are repeats of each other. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import stored

#: Longest run of rows that one search takes.
SEGMENT = 128
#: Characters of the texts after which a segment ends.
SEGMENT_CHARS = 1 << 22
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after system, after user, after assistant. Where a kept initial leads, and what comes next else.
KEEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEXT = [2, 2, 3, 2]
NAME = {2: "user", 3: "assistant"}
ACCEPTED = (0, 3)
#: Solved patterns that a worker remembers.
PATTERNS = 100_000

OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROW = "struct<role:string,text:string>"
PIECE = (
    f"{OUT}, repaired string, whole boolean, conversation string, part int, piece int, pattern string, turn_lo bigint, turn_hi bigint, "
    f"n_turns bigint, first_initial string, last_initial string, kept array<{ROW}>, best array<struct<start:int,end:int,cost:bigint,audit:string>>"
)


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as crc32(``conv_id:turn``) % 20 spoils them; dropped ones stay as marks with null role and text.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    spoiled = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), blank("role").alias("role"), blank("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return spoiled.select(
        "conv_id",
        "turn",
        F.when(F.col("h") != 0, F.when(F.col("h") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(F.col("h") != 0, text).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def lower_bounds(pattern: str, end: int) -> list[tuple[int, int]]:
    """Per place, for a user or an assistant expected next: what the rows from there cost at least until the state ``end``.

    ``pattern`` has two letters a row: initial (s, u, a, else x), fault (``d`` must go, ``t`` truncated, ``-`` none).
    """
    after = (2, 0) if end == 2 else (0, 2)
    out = [after]
    for i in range(len(pattern) - 2, -2, -2):
        initial, fault = pattern[i], pattern[i + 1]
        own = [3 + after[0], 3 + after[1]]
        if fault != "d":
            t = fault == "t"
            for p in (0, 1):
                stay = 2 + after[1 - p]
                if initial == "s":
                    stay = min(stay, after[p])
                elif initial == "ua"[p]:
                    stay = after[1 - p]
                own[p] = min(own[p], stay + t)
        after = (min(own[0], 2 + own[1]), min(own[1], 2 + own[0]))
        out.append(after)
    out.reverse()
    return out


def search(pattern: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from the state ``start`` to one of ``ends``; None: there are none."""
    n = len(pattern) // 2
    bounds = [lower_bounds(pattern, end) for end in ends]
    bound = [[min(b[i][p] for b in bounds) for p in (0, 1)] for i in range(n + 1)]
    incumbent: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None:
            least = cost + bound[i][state == 2]
            if least > incumbent[0] or (least == incumbent[0] and audit > incumbent[1][: len(audit)]):
                continue
        before = table.get((i, state))
        if before is not None and before <= (cost, audit):
            continue
        table[i, state] = cost, audit
        if i == n and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = cost, audit
        to = NEXT[state]
        children = [(cost + 2 + bound[i][to == 2], "I", i, to, cost + 2)]
        if i < n:
            initial, fault = pattern[2 * i], pattern[2 * i + 1]
            children.append((cost + 3 + bound[i + 1][state == 2], "D", i + 1, state, cost + 3))
            if fault != "d":
                t = cost + (fault == "t")
                children.append((t + 2 + bound[i + 1][to == 2], "R", i + 1, to, t + 2))
                kept = KEEP[state].get(initial)
                if kept is not None:
                    children.append((t + bound[i + 1][kept == 2], "K", i + 1, kept, t))
        children.sort(reverse=True)
        stack += [(j, s, c, audit + edit) for _, edit, j, s, c in children]
    return incumbent


_SOLVED: dict[tuple, tuple[int, str] | None] = {}


def solved(pattern: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """``search``, remembered per worker."""
    key = pattern, start, ends
    if key not in _SOLVED:
        if len(_SOLVED) > PATTERNS:
            _SOLVED.clear()
        _SOLVED[key] = search(pattern, start, ends)
    return _SOLVED[key]


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """Lines ``role:text`` of the rows (role, text) after the edits, and the state they lead to."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(NAME[state] + ":")
            continue
        role, text = rows[i]
        i += 1
        if edit == "D":
            continue
        if edit == "R":
            state = NEXT[state]
            role = NAME[state]
        else:
            state = KEEP[state][role[:1]]
        out.append(f"{role}:{text}")
    return out, state


class _Segment:
    """Consecutive rows of one conversation in order, with their faults."""

    def __init__(self, conversation: str, conv_id: int | None) -> None:
        self.conversation, self.conv_id = conversation, conv_id
        self.rows: list[tuple[str, str]] = []
        self.pattern: list[str] = []
        self.turns: list[int] = []
        self.chars = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, turn: int | None, role: str, text: str, earlier: bool) -> None:
        body = text.strip(BLANKS)
        fault = "blank" if not body else "duplicate" if earlier else "truncated" if body[-1] not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        self.rows.append((role, text))
        self.pattern.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + {"blank": "d", "duplicate": "d", "truncated": "t", None: "-"}[fault])
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.chars += len(text)

    def row(self) -> dict:
        initials = [role[:1] for role, _ in self.rows]
        return {
            "conv_id": self.conv_id,
            "conversation": self.conversation,
            **self.faults,
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "pattern": "".join(self.pattern),
            "turn_lo": self.turns[0] if self.turns else None,
            "turn_hi": self.turns[-1] if self.turns else None,
            "n_turns": len(self.turns),
            "first_initial": initials[0] if initials else None,
            "last_initial": initials[-1] if initials else None,
        }


class _Fold:
    """Segments of one conversation in order: per state at the end the best audit, its digest and, on request, its text."""

    def __init__(self, texts: bool) -> None:
        self.texts = texts
        self.best: dict[int, tuple] = {0: ((0, ""), hashlib.sha256(), [], False)}
        self.conv_id: int | None = None
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.lo = self.hi = self.initial = None
        self.n_turns = 0

    def add(self, piece: dict, rows: list[tuple[str, str]], best: dict[tuple[int, int], tuple[int, str]]) -> None:
        self.conv_id = piece["conv_id"]
        for name in self.sums:
            self.sums[name] += piece[name]
        if self.initial is not None and rows:
            self.sums["illegal"] += self.initial + piece["first_initial"] not in LEGAL
        if rows:
            self.initial = piece["last_initial"]
        if piece["turn_lo"] is not None:
            self.n_turns += piece["n_turns"] - (self.hi == piece["turn_lo"])
            self.lo = piece["turn_lo"] if self.lo is None else self.lo
            self.hi = piece["turn_hi"]
        after: dict[int, tuple] = {}
        for start, ((cost, audit), digest, text, some) in self.best.items():
            for end in range(4):
                found = best.get((start, end))
                if found is None:
                    continue
                whole = cost + found[0], audit + found[1]
                if end not in after or whole < after[end][0]:
                    after[end] = whole, digest, text, some, start, found[1]
        self.best = {}
        for end, (whole, digest, text, some, start, audit) in after.items():
            lines, _ = repaired(rows, audit, start)
            new = ("\n" if some and lines else "") + "\n".join(lines)
            digest = digest.copy()
            digest.update(new.encode("utf-8", "surrogatepass"))
            self.best[end] = whole, digest, text + [new] if self.texts else text, some or bool(lines)

    def result(self) -> dict:
        (cost, audit), digest, text, _ = min((self.best[e] for e in ACCEPTED if e in self.best), key=lambda b: b[0])
        return {
            "conv_id": self.conv_id,
            "gaps": 0 if self.lo is None else self.hi - self.lo + 1 - self.n_turns,
            **self.sums,
            "cost": cost,
            "audit": audit,
            "repaired_sha256": digest.hexdigest(),
            "repaired": "".join(text) if self.texts else None,
        }


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size or row.get("kept"):
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _solve_ranges(rows: DataFrame, texts: bool) -> DataFrame:
    """Sorted ranges of rows to results of conversations that lie whole in them, and segments of the others."""
    schema = _arrow_schema(PIECE)

    def finished(segment: _Segment) -> dict:
        fold, own = _Fold(texts), segment.row()
        best = {(0, end): found for end in ACCEPTED if (found := solved(own["pattern"], 0, (end,))) is not None}
        fold.add(own, segment.rows, best)
        return fold.result() | {"whole": True}

    def cut_piece(segment: _Segment, piece: int) -> dict:
        own = segment.row()
        best = [
            {"start": start, "end": end, "cost": found[0], "audit": found[1]}
            for start in range(4)
            for end in range(4)
            if (found := solved(own["pattern"], start, (end,))) is not None
        ]
        kept = [{"role": role, "text": text} for role, text in segment.rows]
        return own | {"whole": False, "part": TaskContext.get().partitionId(), "piece": piece, "kept": kept, "best": best}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        segment: _Segment | None = None
        first, piece, before = True, 0, None
        for batch in batches:
            for conversation, conv_id, turn, role, text, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment is None or segment.conversation != conversation:
                    if segment is not None:
                        # a range's first conversation may have begun in the range before
                        yield cut_piece(segment, piece) if first or piece else finished(segment)
                        first = False
                    segment, piece, before = _Segment(conversation, conv_id), 0, None
                elif len(segment.rows) >= SEGMENT or segment.chars >= SEGMENT_CHARS:
                    yield cut_piece(segment, piece)
                    segment, piece = _Segment(conversation, conv_id), piece + 1
                if role is None:
                    continue
                segment.add(turn, role, text, earlier or before == (turn, role, text))
                before = turn, role, text
        if segment is not None:
            yield cut_piece(segment, piece)  # may go on in the next range

    return rows.mapInArrow(lambda batches: _batches(pieces(batches), schema), PIECE)


def _fold_pieces(pieces: DataFrame, texts: bool) -> DataFrame:
    schema = _arrow_schema(f"{OUT}, repaired string")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        fold, own = None, None
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["conversation"] != own:
                    if fold is not None:
                        yield fold.result()
                    fold, own = _Fold(texts), piece["conversation"]
                best = {(b["start"], b["end"]): (b["cost"], b["audit"]) for b in piece["best"]}
                fold.add(piece, [(r["role"], r["text"]) for r in piece["kept"]], best)
        if fold is not None:
            yield fold.result()

    sorted_pieces = pieces.repartition("conversation").sortWithinPartitions("conversation", "part", "piece")
    return sorted_pieces.mapInArrow(lambda batches: _batches(results(batches), schema), f"{OUT}, repaired string")


def repair(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): figures, cost, audit, digest and, with ``texts``, the repaired text.

    Rows with null role and text only name their conversation, as ``damage`` marks dropped ones; give other nulls as blanks.
    """
    named = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conversation"),
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.when(F.col("role").isNotNull(), F.coalesce(F.col("text").cast("string"), F.lit(" "))).alias("text"),
    )
    # null turns come first: they are less than any other
    keyed = named.withColumn("digest", F.sha2("text", 256))
    stand = keyed.filter("role is not null").groupBy("conversation", "role", "digest").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("unnumbered")
    )
    again = stand.filter("least < most or (unnumbered and least is not null)")
    marked = keyed.join(again, ["conversation", "role", "digest"], "left")
    earlier = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("least") < F.col("turn"))), F.lit(False))
    ordered = (
        marked.select("conversation", "conv_id", "turn", "role", "text", earlier.alias("earlier"))
        .repartitionByRange("conversation", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first())
        .sortWithinPartitions("conversation", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    )
    found = stored(_solve_ranges(ordered, texts), "conversation-pieces")
    columns = [c.split()[0] for c in OUT.split(", ")] + (["repaired"] if texts else [])
    whole = found.filter("whole").select(*columns)
    return whole.unionByName(_fold_pieces(found.filter("not whole"), texts).select(*columns))
