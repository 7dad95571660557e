"""Repair of conversations against all edits of small ones, over fragments, and in edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string, copies long"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """(blank, duplicate, truncated) of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        visible = SEEN.findall(text)
        kind = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit of every row with up to two inserted turns in each gap."""
    kinds = faults(rows)
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (role, text), kind in zip(rows, kinds, strict=True):
        some = [("D", 3, None)]
        if kind not in ("blank", "duplicate"):
            extra = kind == "truncated"
            some += [("K", extra, (role, text)), ("R", 2 + extra, ("user", text)), ("R", 2 + extra, ("assistant", text))]
        choices.append(some)
    best = None
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, said = "", 0, []
            for i, between in enumerate(put):
                said += [(r, "") for r in between]
                audit += "I" * len(between)
                cost += 2 * len(between)
                if i < len(rows):
                    letter, price, row = edits[i]
                    audit, cost = audit + letter, cost + price
                    said += [row] if row else []
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def solved(rows, layers=None):
    """The same by the operator's layers."""
    kinds = [(r[:1], k in ("blank", "duplicate"), k == "truncated") for (r, _), k in zip(rows, faults(rows), strict=True)]
    ways = C.paths(kinds, layers or C.Layers())
    cost, audit = min((c + 2 * C._TO_CLOSE[leave], a + "I" * C._TO_CLOSE[leave]) for entry, leave, c, _, _, a in ways if entry == C.START)
    return cost, audit, list(C.replayed(audit, C.START, iter(rows)))


def test_every_short_conversation():
    layers = C.Layers()
    rows = [("system", "a."), ("user", "b."), ("assistant", "c"), ("user", " "), ("tool", "d."), ("assistant", "c")]
    for n in (1, 2):
        for some in itertools.product(rows, repeat=n):
            assert solved(list(some), layers) == cheapest(list(some)), some
    r = random.Random(3)
    for _ in range(12):
        some = [r.choice(rows) for _ in range(3)]
        assert solved(some, layers) == cheapest(some), some


def test_fragments_give_what_one_pass_gives(spark, monkeypatch):
    r = random.Random(5)
    rows = [(c, t, r.choice(["system", "user", "user", "assistant", "assistant", "x", ""]), r.choice(["one.", "two!", "thr", " ", "four?", f"{t}."]), r.choice([1, 1, 1, 2])) for c in range(40) for t in sorted(r.sample(range(60), r.randrange(1, 30)))]
    df = spark.createDataFrame(rows, ROWS)
    out = {}
    for span in (10**6, 7):
        monkeypatch.setattr(C, "SPAN", span)
        summary, turns = C.repair(df)
        summary = summary.join(C.digests(turns).withColumnRenamed("conv_id", "of"), F.col("conv_id") == F.col("of"), "left")
        out[span] = {x.conv_id: tuple(x) for x in summary.collect()}
    assert out[7] == out[10**6]
    for c in range(40):
        own = [(role, text) for k, t, role, text, n in sorted(rows, key=lambda x: (x[0], x[1])) if k == c for _ in range(n)]
        cost, audit, said = solved(own)
        got = out[7][c]
        assert got[6:8] == (cost, audit)
        assert got[9] == (hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest() if said else None)


def damaged(rows):
    """The rows of the contract, in plain Python."""
    one = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        said = [r[2:] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        kinds = faults(said)
        cost, audit, repaired = solved(said) if said else (0, "", [])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest())
    return out


def test_damage_and_all_columns_with_nulls_ties_and_repeats(spark):
    r = random.Random(8)
    rows = [(c, r.choice([None, *range(8)]), r.choice([None, "", "user", "assistant", "system"]), r.choice([None, "", "a.", "b", "c!\n", "long " * 5000 + "."])) for c in [None, *range(60)] for _ in range(r.randrange(1, 9))]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("copies", "h", "fragment", "audit")})
    got = {x.conv_id: tuple(x)[1:] for x in C.repaired_conversations(df).collect()}
    assert got == expected(rows)


def test_a_long_conversation_is_linear(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t}.", 1) for t in range(30000)]
    summary, turns = C.repair(spark.createDataFrame(rows, ROWS).repartition(8))
    assert summary.count() == 1 and turns.groupBy("role").count().count() == 2
    said = [x.role[0] for x in turns.orderBy("position").collect()]
    assert "".join(said) == "ua" * (len(said) // 2)


def test_conversations_of_an_empty_table_and_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.repaired_conversations(spark.createDataFrame([], schema)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = C.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "a.")], schema)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_a_row_whose_role_is_empty_is_kept_for_nothing():
    assert solved([("user", "a."), ("", "b."), ("assistant", "c.")]) == (0, "KKK", [("user", "a."), ("", "b."), ("assistant", "c.")])


@pytest.mark.parametrize("rows, audit", [([("assistant", "a.")], "IK"), ([("user", "a.")], "KI"), ([("system", "a."), ("assistant", "b.")], "KIK"), ([("user", "a."), ("user", "a.")], "KDI"), ([("assistant", "a"), ("assistant", "a")], "DD")])
def test_ties_go_to_the_least_audit(rows, audit):
    assert solved(rows) == cheapest(rows)
    assert solved(rows)[1] == audit
