"""Conversation structure repair: the cheapest edits that make each conversation's roles legal, by a forward Viterbi pass.

The grammar of role initials is ``(s?(ua)+)?``, so four states do: nothing yet, after the system turn, after a user turn, after an
assistant turn. Each turn is a layer; a state carries the least (cost, audit string) of the edits that lead there, and
a layer is closed with at most two inserted turns. As only the order of the four strings decides what follows, layers keep their
ranks and back pointers in place of the strings, and equal layers are looked up in a table.

A conversation is cut into fragments by ranges of ``SPAN`` turns. A fragment's result is its least (cost, rank) from each state to each
state, and these small matrices are multiplied along the conversation; so fragments of one long conversation
run in different tasks, and rows are streamed through them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Turns of a conversation in a fragment.
SPAN = 1024
#: Rows and characters of text in a batch that a task gives back.
OUT_ROWS, OUT_CHARS = 8192, 1 << 22

START, SYSTEM, USER, ASSISTANT = range(4)
WHITE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_BEFORE_USER = (START, SYSTEM, ASSISTANT)
#: State after up to two inserted turns; more never pay.
_INSERTED = {START: (START, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}
#: Turns to insert at the end, by state.
_TO_CLOSE = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Vector = tuple  # of four (cost, rank) or None


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): test damage by crc32 of ``conv_id:turn`` modulo 20, nulls being one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 gives it two copies, 4 makes it the user's. Null ids and turns stay null.
    """
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spoken("role").alias("role"), spoken("text").alias("text"), (F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letters) of a row's edits, inserted turns before it included."""
    out = []
    for state, inserted in _INSERTED.items():
        for n, at in enumerate(inserted):
            cost, letters = n * INSERT, "I" * n
            out.append((state, at, cost + DELETE, letters + "D"))
            if must_go:
                continue
            for letter, to, extra in (("K", _kept(at, initial), 0), ("R", USER if at in _BEFORE_USER else ASSISTANT, REROLE)):
                if to is not None:
                    out.append((state, to, cost + extra + TRUNCATED * truncated, letters + letter))
    return out


def _kept(state: int, initial: str) -> int | None:
    """The state after a turn that is kept; an empty role adds nothing to the initials. None if the grammar forbids it."""
    if initial == "":
        return state
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state in _BEFORE_USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _layer(before: Vector, steps: Iterable[tuple[int, int, int, object]]) -> tuple[int, Vector, tuple]:
    """(shift, vector, back) of the next layer: costs without the least, dense ranks, and (state, letters) by state.

    No string of a layer begins another, as each ends in a row's letter and has the same number of them; so (rank, letters) orders them.
    """
    best: list = [None] * 4
    for state, to, cost, letters in steps:
        if before[state] is not None:
            c, r = before[state]
            found = (c + cost, r, letters, state)
            if best[to] is None or found < best[to]:
                best[to] = found
    ranks = {x: i for i, x in enumerate(sorted({b[1:3] for b in best if b is not None}))}
    shift = min(b[0] for b in best if b is not None)
    vector = tuple(None if b is None else (b[0] - shift, ranks[b[1:3]]) for b in best)
    return shift, vector, tuple(None if b is None else (b[3], b[2]) for b in best)


class Layers:
    """Layers that were met before; there are few, as costs differ by little."""

    def __init__(self):
        self.known: dict = {}
        self.steps: dict = {}

    def after(self, before: Vector, kind: tuple[str, bool, bool]) -> tuple[int, Vector, tuple]:
        found = self.known.get((before, kind))
        if found is None:
            if kind not in self.steps:
                self.steps[kind] = moves(*kind)
            found = self.known[before, kind] = _layer(before, self.steps[kind])
        return found


def paths(kinds: list[tuple[str, bool, bool]], layers: Layers) -> list[tuple[int, int, int, int, int, str]]:
    """(entry, exit, cost, rank, kept, audit) of a fragment: the best edits between each two states; ranks order all audits."""
    out = []
    for entry in range(4):
        vector: Vector = tuple((0, 0) if s == entry else None for s in range(4))
        total, trail = 0, []
        for kind in kinds:
            shift, vector, back = layers.after(vector, kind)
            total += shift
            trail.append(back)
        for leave, end in enumerate(vector):
            if end is not None:
                at, letters = leave, []
                for back in reversed(trail):
                    at, last = back[at]
                    letters.append(last)
                audit = "".join(reversed(letters))
                out.append((entry, leave, total + end[0], len(audit) - audit.count("D"), audit))
    ranks = {a: i for i, a in enumerate(sorted({p[4] for p in out}))}
    return [(e, x, cost, ranks[a], kept, a) for e, x, cost, kept, a in out]


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, chars: Callable[[tuple], int] = lambda _: 0) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += chars(row)
        if len(some) >= OUT_ROWS or size >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


_PATH = pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("kept", pa.int64()), ("audit", pa.string())])
_FRAGMENT = pa.schema([("conv_id", pa.int64()), ("fragment", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("paths", pa.list_(_PATH))])
_FRAGMENT_SQL = "conv_id long, fragment long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, paths array<struct<entry:int,leave:int,cost:long,rank:int,kept:long,audit:string>>"
_LEGAL = {"su", "ua", "au"}


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, fragment, turn, initial, blank, later, truncated, copies) to a row a fragment."""
    layers = Layers()

    def found() -> Iterator[tuple]:
        for (conv, fragment), rows in groupby(_streamed(batches), lambda r: r[:2]):
            first = last = before = start = None
            turns = blanks = duplicates = cut = illegal = 0
            kinds = []
            for _, _, turn, initial, blank, later, truncated, copies in rows:
                if turn is not None:
                    first = turn if first is None else first
                    turns += turn != last
                    last = turn
                start = initial if start is None else start
                illegal += before is not None and before + initial not in _LEGAL
                illegal += (copies - 1) * (initial + initial not in _LEGAL)
                before = initial
                blanks += copies * blank
                duplicates += (copies - (not later)) * (not blank)
                cut += not blank and not later and truncated
                kinds.append((initial, blank or later, truncated and not blank and not later))
                kinds.extend([(initial, True, False)] * (copies - 1))
            yield conv, fragment, first, last, turns, start, before, blanks, duplicates, cut, illegal, [dict(zip(("entry", "leave", "cost", "rank", "kept", "audit"), p, strict=True)) for p in paths(kinds, layers)]

    yield from _batches(found(), _FRAGMENT)


_CHOICE = pa.schema([("conv_id", pa.int64()), ("fragment", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("at", pa.int64()), ("tail", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())])
_CHOICE_SQL = "conv_id long, fragment long, entry int, leave int, at long, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments without audits, sorted, to the path that each takes; the last one of a conversation carries its totals."""

    def found() -> Iterator[tuple]:
        for conv, rows in groupby(_streamed(batches), lambda r: r[0]):
            vector: Vector = ((0, 0), None, None, None)
            total, trail, first, last, before = 0, [], None, None, None
            turns = blanks = duplicates = cut = illegal = 0
            for _, fragment, low, high, n, start, end, b, d, t, i, ways in rows:
                steps = [(w["entry"], w["leave"], w["cost"], w["rank"]) for w in ways]
                shift, vector, back = _layer(vector, steps)
                total += shift
                trail.append((fragment, back, {(w["entry"], w["leave"]): w["kept"] for w in ways}))
                if low is not None:
                    first = low if first is None else first
                    turns += n - (low == last)
                    last = high
                illegal += i + (before is not None and before + start not in _LEGAL)
                before = end
                blanks, duplicates, cut = blanks + b, duplicates + d, cut + t
            cost, _, tail, state = min((v[0] + INSERT * _TO_CLOSE[s], v[1], "I" * _TO_CLOSE[s], s) for s, v in enumerate(vector) if v is not None)
            taken = []
            for fragment, back, kept in reversed(trail):
                entry = back[state][0]
                taken.append((fragment, entry, state, kept[entry, state]))
                state = entry
            at = 0
            for fragment, entry, leave, kept in reversed(taken[1:]):
                yield conv, fragment, entry, leave, at, "", None, None, None, None, None, None
                at += kept
            fragment, entry, leave, _ = taken[0]
            gaps = 0 if first is None else last - first + 1 - turns
            yield conv, fragment, entry, leave, at, tail, gaps, blanks, duplicates, cut, illegal, total + cost

    yield from _batches(found(), _CHOICE)


def replayed(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits of ``audit`` on (role, text) rows, from ``state`` on."""
    for letter in audit:
        if letter == "I":
            state = USER if state != USER else ASSISTANT
            yield ("user" if state == USER else "assistant"), ""
            continue
        role, text = next(rows)
        if letter == "K":
            state = _kept(state, role[:1])
            yield role, text
        elif letter == "R":
            state = USER if state != USER else ASSISTANT
            yield ("user" if state == USER else "assistant"), text


_TURN = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_TURN_SQL = "conv_id long, position long, role string, text string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment's heading (audit, entry, at) and after it its sorted rows (role, text, copies), to the repaired turns."""

    def found() -> Iterator[tuple]:
        for (conv, _), rows in groupby(_streamed(batches), lambda r: r[:2]):
            _, _, audit, entry, at, _, _, _ = next(rows)
            spoken = ((role, text) for *_, role, text, copies in rows for _ in range(copies))
            for i, (role, text) in enumerate(replayed(audit, entry, spoken)):
                yield conv, at + i, role, text

    yield from _batches(found(), _TURN, lambda r: len(r[3]))


def _fragment_of(turn: str = "turn") -> Column:
    """The fragment of a turn; null turns come first."""
    return F.coalesce(F.floor(F.col(turn) / F.lit(SPAN)).cast("long"), F.lit(-(2**63)))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of ``rows(conv_id, turn, role, text, copies)``, whose rows stand in order of turn (nulls first), role and text hash.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row a conversation with rows, and the repaired turns (conv_id,
    position, role, text). Each row's first fault counts: blank (no visible character), duplicate (role and text seen earlier),
    truncated (the last visible character is none of ``.!?``). Edits: keep 0, rerole to user or assistant 2, delete 3 (the only one for
    blanks and duplicates), insert an empty turn 2; a truncated row that stays adds 1. The audit has their
    initials, the least of equals. An empty role is kept for nothing and says nothing; a null id is one conversation; a null role or text is one space; columns
    beyond the five are ignored; an empty table gives empty tables; a conversation or text may be of any length.
    """
    spark = rows.sparkSession
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    said = said.withColumn("h", F.unhex(F.md5("text")))
    tail = F.rtrim("text", F.lit(WHITE))
    light = said.select("conv_id", "turn", "role", "h", (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    light = written(light.groupBy("conv_id", "turn", "role", "h", "blank", "truncated").agg(F.sum("copies").alias("copies")))  # equal rows meet before they are dealt out
    place = F.struct(F.col("turn").isNotNull(), "turn")
    seen = light.groupBy("conv_id", "role", "h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k"), "first")
    flagged = light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")), "left")
    flagged = flagged.select("conv_id", _fragment_of().alias("fragment"), "turn", "role", "h", "blank", (F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))).alias("later"), "truncated", "copies")
    dealt = flagged.repartition("conv_id", "fragment").sortWithinPartitions("conv_id", "fragment", "turn", "role", "h")
    fragments = written(dealt.select("conv_id", "fragment", "turn", F.left("role", F.lit(1)), "blank", "later", "truncated", "copies").mapInArrow(_fragments, _FRAGMENT_SQL))

    small = fragments.withColumn("paths", F.transform("paths", lambda p: p.dropFields("audit")))
    choices = small.repartition("conv_id").sortWithinPartitions("conv_id", "fragment").mapInArrow(_choices, _CHOICE_SQL)
    audits = fragments.select(F.col("conv_id").alias("c"), F.col("fragment").alias("f"), "paths")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("fragment") == F.col("f"))
    own = F.filter("paths", lambda p: (p.entry == F.col("entry")) & (p.leave == F.col("leave")))[0].audit
    taken = written(choices.join(audits, same).select(*(x.name for x in _CHOICE), F.concat(own, "tail").alias("audit")))

    pieces = F.array_sort(F.collect_list(F.struct("fragment", "audit")))
    totals = [F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]  # one fragment has them
    summary = taken.groupBy("conv_id").agg(*totals, F.array_join(F.transform(pieces, lambda p: p.audit), "").alias("audit"))

    none = F.lit(None)
    heads = taken.select("conv_id", "fragment", "audit", "entry", "at", none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), none.cast("long").alias("turn"), none.cast("binary").alias("h"), F.lit(0).alias("body"))
    bodies = said.select("conv_id", _fragment_of().alias("fragment"), none.cast("string").alias("audit"), none.cast("int").alias("entry"), none.cast("long").alias("at"), "role", "text", "copies", "turn", "h", F.lit(1).alias("body"))
    both = heads.unionByName(bodies).repartition("conv_id", "fragment").sortWithinPartitions("conv_id", "fragment", "body", "turn", "role", "h")
    turns = both.select("conv_id", "fragment", "audit", "entry", "at", "role", "text", "copies").mapInArrow(_turns, _TURN_SQL)
    return summary, turns


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        for conv, rows in groupby(_streamed(batches), lambda r: r[0]):
            h, between = hashlib.sha256(), b""
            for _, role, text in rows:
                h.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield conv, h.hexdigest()

    yield from _batches(found(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of each conversation's ``role:text`` turns joined by newlines, streamed in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """A row for each id of ``conversations``: the faults and edits of its damaged rows, and the digest of what they are repaired to.

    A conversation that lost all rows has zeros, no audit and the digest of nothing. A null id is a conversation, too.
    """
    summary, turns = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    hashes = digests(turns).select(F.col("conv_id").alias("of"), "repaired_sha256")
    out = ids.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
