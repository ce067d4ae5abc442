"""The repair against a search over all edits, through stretches of every length, and on odd rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from itertools import count

import pytest

from stroma.llm import conversation as c

TURNS = "conv_id long, turn long, role string, text string, stretch int, key string, kind int, letters string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "x") for r in rows], TURNS)


def in_order(rows):
    """A conversation's (turn, role, text): by turn, null first, then md5; nulls are one space."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, repaired) of the cheapest edits, ties by letters: a search in order of (cost, letters) over all edits, none left out."""
    wrong, tick = faults(rows), count()
    heap = [(0, "", next(tick), 0, "", [])]
    while True:
        cost, audit, _, k, roles, made = heapq.heappop(heap)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)
        push = lambda more, letter, k, turn=None: heapq.heappush(heap, (cost + more, audit + letter, next(tick), k, roles + (turn[0][:1] or "-" if turn else ""), made + [turn] if turn else made))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if re.fullmatch("s?(ua)*u?", roles + role[0]):
                push(3, "I", k, (role, ""))
        if k < len(rows):
            _, role, text = rows[k]
            push(4, "D", k + 1)
            if wrong[k] not in ("blank", "duplicate"):
                for letter, new, more in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if re.fullmatch("s?(ua)*u?", roles + (new[:1] or "-")):
                        push(more + 3 * (wrong[k] == "truncated"), letter, k + 1, (new, text))


def expected(rows):
    rows = in_order(rows)
    wrong, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, repaired = searched(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(wrong.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def random_rows(rng, n):
    return [(rng.choice([None, *range(n), *range(n)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"]), rng.choice(["Yes.", "no", "Why?", " ", None, f"T{rng.random()}.", f"T{rng.random()}! \n", "Ends so …"])) for _ in range(n)]


@pytest.mark.parametrize("stretch_rows", [100_000, 7])
def test_cheapest_edits(spark, stretch_rows):
    rng = random.Random(stretch_rows)
    convs = {(None if k == 0 else k): random_rows(rng, rng.randint(0, 6)) for k in range(70)}
    rows = [(k, *r) for k, rs in convs.items() for r in rs]
    none = [(k, None, None, None) for k in convs]
    found = c.summarise(table(spark, rows), table(spark, none), stretch_rows).collect()
    have = {r[0]: tuple(r[1:]) for r in found}
    assert len(found) == len(convs) and have == {k: expected(rs) for k, rs in convs.items()}
    repaired = {}
    for r in sorted(c.repair(table(spark, rows), stretch_rows).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.stretch, r.place)):
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for k in convs:
        assert hashlib.sha256("\n".join(repaired.get(k, [])).encode()).hexdigest() == have[k][-1]


def test_one_long_conversation_in_stretches(spark):
    rng = random.Random(5)
    rows = [(1, t, *random_rows(rng, 1)[0][1:]) for t in range(3000)] + [(2, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(10)]
    one, many = (sorted(map(tuple, c.summarise(table(spark, rows), None, n).collect())) for n in (100_000, 40))
    assert one == many and c.plan(table(spark, rows), 40).where("conv_id = 1").count() > 20
    audit = one[0][7]
    assert one[0][6] == sum({"D": 4, "I": 3, "K": 0, "R": 3}[x] for x in audit) + 3 * kept_open(rows, audit)
    texts = c.repair(table(spark, rows), 40).where("conv_id = 1").collect()
    assert len(texts) == sum(x != "D" for x in audit)


def kept_open(rows, audit):
    held = in_order([r[1:] for r in rows if r[0] == 1])
    return sum(w == "truncated" and x != "D" for w, x in zip(faults(held), audit.replace("I", ""), strict=True))


def test_no_rows(spark):
    assert c.summarise(table(spark, [])).count() == 0 and c.repair(table(spark, [])).count() == 0
    got = c.summarise(table(spark, []), table(spark, [(7, 1, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, 0, "user", "Long. " * 60_000)] * 3 + [(1, 1, "assistant", "A " * 100_000)]
    got = c.summarise(table(spark, rows)).collect()[0]
    assert got.audit == "KDDK" and got.cost == 11 and (got.duplicate, got.truncated) == (2, 1)
    assert [r.edit for r in sorted(c.repair(table(spark, rows)).collect(), key=lambda r: r.place)] == ["keep", "keep"]
