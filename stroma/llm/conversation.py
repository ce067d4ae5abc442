"""Repair of conversations: the cheapest edits that make their turns follow (s?(ua)+)?.

A retained-subsequence program: a turn is kept, given another role, or deleted. What a gap
between two retained turns costs are its deletions, a difference of prefix sums, and the
turns that the two roles need between them. So it's enough to carry, for each role that
may be the last retained one, the least cost less the deletions up to here (a running
minimum). Equal costs are decided by the edits' letters; only the order of the four
minima's letters matters, not the letters themselves. There are few such states, so
steps between them are remembered.

The minima also go through a stretch of a conversation from each role before it to each
role after it. Long conversations are cut into stretches that are solved apart; a scan of
their small tables then picks the roles at the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import materialise, ship_package

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Distinct turns of a stretch of a long conversation.
STRETCH_ROWS = 100_000
#: Up to so many conversations of several stretches are broadcast with their stretches' first turns.
BROADCAST_CONVERSATIONS = 100_000

_BLANK = r"[\x20\x09-\x0D]"
# the last retained turn's role: none yet, or its initial
START, S, U, A = range(4)
_ROLES = {"s": S, "u": U, "a": A}
#: Turns to be put in between one retained role and the next, and after the last one.
_BETWEEN = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
_AFTER = {START: 0, S: 2, U: 1, A: 0}
_LEGAL = {(S, U), (U, A), (A, U)}

#: A program's state: relative costs of the four last roles (None: not reachable), and the order of their letters.
Minima = tuple[tuple[int | None, ...], tuple[int, ...]]


def entered(role: int) -> Minima:
    return tuple(0 if q == role else None for q in range(4)), (0, 0, 0, 0)


@cache
def advance(minima: Minima, must: bool, role: int, cut: bool) -> tuple[Minima, int, tuple]:
    """The minima after one more turn, by how much all of them fell or rose, and (role before, letters) for each role.

    ``must``: the turn has to be deleted; ``role``: its initial's (START: another one);
    ``cut``: it costs more unless deleted. Costs are relative to deleting all turns.
    """
    costs, order = minima
    chosen: list[tuple | None] = []
    for to in range(4):
        ways = [] if costs[to] is None else [(costs[to], order[to], "D", to)]
        if to != START and not must:
            own = CUT * cut - DELETE
            letters = ([("K", 0)] if role == to else []) + ([("R", RETYPE)] if to in (U, A) else [])
            for (before, after), many in _BETWEEN.items():
                if after == to and costs[before] is not None:
                    ways += [(costs[before] + INSERT * many + own + more, order[before], "I" * many + letter, before) for letter, more in letters]
        chosen.append(min(ways) if ways else None)
    least = min(w[0] for w in chosen if w)
    ranked = sorted(w[1:3] for w in chosen if w)
    after = tuple(w and w[0] - least for w in chosen), tuple(ranked.index(w[1:3]) if w else 0 for w in chosen)
    return after, least, tuple(w and (w[3], w[2]) for w in chosen)


class Program:
    """One stretch's program from one role before it."""

    def __init__(self, role: int):
        self.minima, self.cost, self.steps = entered(role), 0, []

    def add(self, must: bool, role: int, cut: bool) -> None:
        self.minima, fell, back = advance(self.minima, must, role, cut)
        self.cost += fell + DELETE
        self.steps.append(back)

    def ways(self) -> Iterator[tuple[int, int, int, str]]:
        """(role after, cost, place in the order of letters, letters)."""
        costs, order = self.minima
        for to in range(4):
            if costs[to] is not None:
                at, letters = to, []
                for back in reversed(self.steps):
                    at, some = back[at]
                    letters.append(some)
                yield to, self.cost + costs[to], order[to], "".join(reversed(letters))


def ended(costs: dict[int, int], order: dict[int, int]) -> tuple[int, int]:
    """The last retained role of the cheapest whole conversation, and its cost."""
    last = min(costs, key=lambda q: (costs[q] + INSERT * _AFTER[q], order[q]))
    return last, costs[last] + INSERT * _AFTER[last]


def clean(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text), null roles and texts one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def _key() -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


_STRETCH = "conv_id long, stretch int, first_turn long, first_key binary, counts array<long>, edge array<long>, ways array<struct<enter:int,leave:int,cost:long,place:int>>, letters array<string>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _solved(batches):
    """One row for each stretch of a conversation in a partition that is sorted by it and its turns."""
    way = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("place", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int32()), ("first_turn", pa.int64()), ("first_key", pa.binary()), ("counts", pa.list_(pa.int64())), ("edge", pa.list_(pa.int64())), ("ways", way), ("letters", pa.list_(pa.string()))])
    made, held, now = [], None, None

    def close():
        if held:
            found = [(enter, *w) for enter, p in held["programs"].items() for w in p.ways()]
            edge = [held["first_role"], held["role"], held["low"], held["high"]]
            made.append({"conv_id": now[0], "stretch": held["stretch"], "first_turn": held["at"][0], "first_key": held["at"][1], "counts": held["counts"], "edge": edge, "ways": [dict(zip(("enter", "leave", "cost", "place"), w[:4], strict=True)) for w in found], "letters": [w[4] for w in found]})

    for conv, turn, key, n, role, blank, cut, new, stretch in _rows(batches):
        if now != (conv,):
            close()
            # a partition's first conversation may have begun in the partition before
            enters = range(4) if now is None else (START,)
            now = (conv,)
            held = {"stretch": stretch, "at": (turn, key), "counts": [0] * 5, "programs": {q: Program(q) for q in enters}, "first_role": role, "role": None, "low": None, "high": None}
            if len(made) >= 500:
                yield _batch(made, schema)
                made.clear()
        counts = held["counts"]
        if turn is not None and turn != held["high"]:
            counts[4] += 1
            held["low"], held["high"] = turn if held["low"] is None else held["low"], turn
        for copy in range(n):
            again = copy > 0 or not new
            counts[0] += blank
            counts[1] += again and not blank
            counts[2] += cut and not again and not blank
            counts[3] += held["role"] is not None and (held["role"], role) not in _LEGAL
            held["role"] = role
            for p in held["programs"].values():
                p.add(blank or again, role, cut)
    close()
    if made:
        yield _batch(made, schema)


_PICKED = "conv_id long, stretch int, enter int, leave int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _picked(batches):
    """The roles at the cuts of each conversation, from its stretches in order, and its sums on the last one's row."""
    names = ("conv_id", "stretch", "enter", "leave", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([(c, pa.int32() if c in ("stretch", "enter", "leave") else pa.bool_() if c == "last" else pa.int64()) for c in names])

    def whole(conv, stretches):
        costs, order, steps = {START: 0}, {START: 0}, []
        for _, _, _, ways in stretches:
            best: dict[int, tuple] = {}
            for w in ways:
                if w["enter"] in costs:
                    way = (costs[w["enter"]] + w["cost"], order[w["enter"]], w["place"], w["enter"])
                    best[w["leave"]] = min(best.get(w["leave"], way), way)
            ranked = sorted(w[1:3] for w in best.values())
            costs, order = {q: w[0] for q, w in best.items()}, {q: ranked.index(w[1:3]) for q, w in best.items()}
            steps.append({q: w[3] for q, w in best.items()})
        at, cost = ended(costs, order)
        sums, role, low, high = [0] * 5, None, None, None
        for _, counts, (first, last, early, late), _ in stretches:
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            sums[3] += role is not None and (role, first) not in _LEGAL
            sums[4] -= high is not None and high == early
            role, low, high = last, early if low is None else low, late if late is not None else high
        gaps = high - low + 1 - sums[4] if low is not None else 0
        out = []
        for k in reversed(range(len(stretches))):
            out.append(dict(zip(names, (conv, stretches[k][0], steps[k][at], at, k == len(stretches) - 1, gaps, *sums[:4], cost), strict=True)))
            at = steps[k][at]
        return out

    made, held, now = [], [], None
    for conv, *stretch in _rows(batches):
        if held and conv != now:
            made += whole(now, held)
            held = []
            if len(made) >= 2_000:
                yield _batch(made, schema)
                made = []
        now = conv
        held.append(stretch)
    if held:
        made += whole(now, held)
    if made:
        yield _batch(made, schema)


def plan(turns: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """(conv_id, stretch, first_turn, first_key, enter, leave, letters, last, gaps, blank, duplicate, truncated, illegal, cost): the stretches of each conversation.

    ``letters`` are the edits of a stretch, ``enter`` and ``leave`` the last retained roles
    before and after it; on all rows of a conversation stand its sums. Only keys and flags
    of turns are shuffled here, equal turns combined first. A duplicate is a turn other
    than the first of its role and text; the first ones come from an aggregate and are
    joined by conversation, turn and text, a key that is unique. Stretches are ranges of
    the sorted turns, so no task has a whole long conversation; what is scanned a
    conversation is one row a stretch.
    """
    ship_package(turns.sparkSession)
    rows = clean(turns)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(START).alias("role")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{_BLANK}*\z")
    slim = rows.select("conv_id", "turn", _key().alias("key"), role, blank.alias("blank"), cut.alias("cut"))
    equal = slim.groupBy("conv_id", "turn", "key", "role", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    equal = materialise(equal, "turns-equal")
    first = equal.groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), F.col("_first.turn").alias("_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("key") == F.col("_key"))
    flagged = materialise(equal.join(first, same, "left").select("conv_id", "turn", "key", "n", "role", "blank", "cut", F.col("_key").isNotNull().alias("new")), "turns-flagged")
    runs = max(1, -(-flagged.count() // stretch_rows))
    ordered = flagged.repartitionByRange(runs, "conv_id", "turn", "key").sortWithinPartitions("conv_id", "turn", "key").withColumn("stretch", F.spark_partition_id())
    solved = materialise(ordered.mapInArrow(_solved, _STRETCH), "turns-solved")
    small = solved.select("conv_id", "stretch", "counts", "edge", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    picked = small.mapInArrow(_picked, _PICKED).withColumnsRenamed({"conv_id": "_conv", "stretch": "_stretch"})
    joined = solved.join(picked, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch")))
    way = F.array_position(F.transform("ways", lambda w: F.struct(w["enter"].alias("enter"), w["leave"].alias("leave"))), F.struct("enter", "leave"))
    return materialise(joined.select("conv_id", "stretch", "first_turn", "first_key", "enter", "leave", F.element_at("letters", way.cast("int")).alias("letters"), "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "turns-plan")


class Editor:
    """Applies letters to turns as they come, in order."""

    def __init__(self, role: int, letters: str):
        self.role, self.letters, self.at = role, letters, 0

    def following(self) -> str:
        return "assistant" if self.role == U else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            role = self.following()
            self.role, self.at = _ROLES[role[0]], self.at + 1
            yield role, "", "insert"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            role = role if letter == "K" else self.following()
            self.role = _ROLES[role[0]]
            yield role, text, "keep" if letter == "K" else "rerole"


def _texts(turns: DataFrame) -> DataFrame:
    return clean(turns).withColumn("key", _key())


def _together(planned: DataFrame, texts: DataFrame, conversations: DataFrame | None, *group: str) -> DataFrame:
    """Plans, then turns, of each group in one task and in order: (conv_id, stretch, kind, turn, key, role, text, plan)."""
    pieces = planned.select("conv_id", "stretch", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("role"), F.col("letters").alias("text"), F.struct("enter", "leave", "last", "gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("plan"))
    stretch = F.col("stretch") if "stretch" in group else F.lit(1 << 30)
    plan_type = pieces.schema["plan"].dataType.simpleString()
    rows = pieces.unionByName(texts.select("conv_id", stretch.cast("int").alias("stretch"), F.lit(2).alias("kind"), "turn", "key", "role", "text", F.lit(None).cast(plan_type).alias("plan")))
    if conversations is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("key", "binary"), ("role", "string"), ("text", "string"), ("plan", plan_type))]
        rows = rows.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(-1).alias("stretch"), F.lit(0).alias("kind"), *none).distinct())
    return rows.repartition(*group).sortWithinPartitions(*group, "kind", "stretch", "turn", "key").select("conv_id", "stretch", "kind", "role", "text", "plan")


def repair(turns: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """(conv_id, stretch, place, role, text, edit): the repaired turns of each conversation, in the order of stretch and place.

    ``turns`` (conv_id, turn, role, text, ...): a conversation's rows by turn, null first,
    those of one turn by md5 of role and text. Rows without a character other than blanks
    and rows whose role and text stood before are deleted; any other may be kept, given the
    role user or assistant (3), or deleted (4), and empty turns of user or assistant may be
    put anywhere (3), so that the roles' initials follow (s?(ua)+)?; a row left in that
    doesn't end in . ! or ? costs 3 more. The cheapest edits are made, of several those
    whose initials (Delete, Insert, Keep, Rerole) come first.

    Null roles and texts count as one space, rows of a null conv_id as one conversation.
    A conversation of which nothing is left has no row here. Long conversations are
    edited stretch by stretch, each in a task; a table without rows gives none.
    """
    planned = plan(turns, stretch_rows)
    start = F.struct(F.col("first_turn").isNotNull().alias("known"), "first_turn", "first_key", "stretch")
    # conversations of several stretches span partitions, so they are fewer than these
    several = materialise(planned.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(start)).alias("_starts")).where(F.size("_starts") > 1), "turns-several")
    small = F.broadcast(several) if several.count() <= BROADCAST_CONVERSATIONS else several
    of = lambda df: df.join(small, df["conv_id"].eqNullSafe(small["_conv"]), "left")
    here = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first_turn"), F.col("key").alias("first_key"), F.lit((1 << 31) - 1).alias("stretch"))
    placed = of(_texts(turns)).withColumn("stretch", F.coalesce(F.element_at(F.filter("_starts", lambda s: s <= here), -1)["stretch"], F.lit(0)))
    planned = of(planned).withColumn("stretch", F.when(F.col("_starts").isNotNull(), F.col("stretch")).otherwise(0))
    out = "conv_id long, stretch int, place long, role string, text string, edit string"
    schema = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        editor, now, last, place, made = None, None, False, 0, []

        def put(turns):
            nonlocal place
            for role, text, edit in turns:
                made.append({"conv_id": now[0], "stretch": now[1], "place": place, "role": role, "text": text, "edit": edit})
                place += 1

        def close():
            if editor and last:
                put(editor.inserted())
                put(_closing(editor))

        for conv, stretch, kind, role, text, plan in _rows(batches):
            if kind == 1:
                close()
                editor, now, last, place = Editor(plan["enter"], text), (conv, stretch), plan["last"], 0
            else:
                put(editor.take(role, text))
            if len(made) >= 1_000:
                yield _batch(made, schema)
                made.clear()
        close()
        if made:
            yield _batch(made, schema)

    return _together(planned, placed, None, "conv_id", "stretch").mapInArrow(run, out)


def _closing(editor: Editor) -> Iterator[tuple[str, str, str]]:
    for _ in range(_AFTER[editor.role]):
        role = editor.following()
        editor.role = _ROLES[role[0]]
        yield role, "", "insert"


def summarise(turns: DataFrame, conversations: DataFrame | None = None, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of ``turns``, and of ``conversations`` if given.

    Edits are ``repair``'s; ``audit`` has their initials in order; the digest is that of the
    repaired ``role:text``, joined by newlines. ``gaps`` are turn numbers missing between
    the least and the greatest; faults are counted by each row's first one; ``illegal`` are
    neighbours whose roles' initials aren't su, ua or au. A conversation without rows has
    zeros and empty texts. As a digest reads one byte after the other, each
    conversation's texts pass through one task; they are streamed in order, and only the
    audit's letters, one a turn, are held.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = f"conv_id long, {', '.join(f'{c} long' for c in names)}, audit string, repaired_sha256 string"
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        now, made = None, []

        def feed(turns):
            nonlocal begun
            for role, text, _ in turns:
                sha.update(f"{chr(10) * begun}{role}:{text}".encode())
                begun = True

        def close():
            if now is None:
                return
            start_texts()
            feed(editor.inserted())
            feed(_closing(editor))
            audit = editor.letters + "I" * (len(list(_closing(Editor(role_before_end, ""))))) if sums else ""
            made.append({"conv_id": now[0], **{c: sums[c] if sums else 0 for c in names}, "audit": audit, "repaired_sha256": sha.hexdigest()})

        def start_texts():
            nonlocal editor
            if editor is None:
                editor = Editor(START, "".join(pieces))

        begun = False
        sha, pieces, editor, sums, role_before_end = hashlib.sha256(), [], None, None, START
        for conv, _, kind, role, text, plan in _rows(batches):
            if now != (conv,):
                close()
                now, begun = (conv,), False
                sha, pieces, editor, sums, role_before_end = hashlib.sha256(), [], None, None, START
                if len(made) >= 1_000:
                    yield _batch(made, schema)
                    made.clear()
            if kind == 1:
                pieces.append(text)
                if plan["last"]:
                    sums, role_before_end = plan, plan["leave"]
            elif kind == 2:
                start_texts()
                feed(editor.take(role, text))
        close()
        if made:
            yield _batch(made, schema)

    return _together(plan(turns, stretch_rows), _texts(turns), conversations, "conv_id").mapInArrow(run, out)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its . ! and ?, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    rows = clean(turns)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    faulty = rows.withColumn("_fault", fault).where("_fault != 0")
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return faulty.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
