import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from frostline.llm import conversations
from frostline.llm.queries import ORACLES, QUERIES

from ..compare import assert_same, connection
from .test_dedup import SF

SCHEMA = "conv_id long, turn long, role string, text string, place int, fault string"
WHITE = " \t\n\x0b\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NONE = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def put(ways, state, way):
    ways[state] = min(way, ways.get(state, way))


def with_inserts(ways):
    for _ in range(4):
        for state, (cost, audit, lines) in list(ways.items()):
            for role in ("user", "assistant"):
                if (state, role[0]) in NEXT:
                    put(ways, NEXT[state, role[0]], (cost + 2, audit + "I", (*lines, f"{role}:")))
    return ways


def solved(rows):
    """All edits of one conversation's rows (turn, role, text), with as many insertions anywhere as one likes."""
    seen, faults = set(), []
    for _, role, text in rows:
        cut = text.rstrip(WHITE)
        faults.append("blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = with_inserts({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in ways.items():
            put(after, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                for price, edit, new in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                    if (state, new[:1]) in NEXT:
                        put(after, NEXT[state, new[:1]], (cost + price + (fault == "truncated"), audit + edit, (*lines, f"{new}:{text}")))
        ways = with_inserts(after)
    cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def expected(rows):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged([r[:4] for r in rows]):
        by[conv].append((turn, role, text))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())
    return {c: solved(sorted(v, key=order)) if v else NONE for c, v in by.items()}


def found(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in conversations.damage_and_repair(df).collect()}


def test_query_equals_its_sql(spark):
    name = "op13_conversation_repair"
    assert_same(QUERIES[name](spark, SF).toPandas(), connection(SF).sql(ORACLES[name]).df())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == expected(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    roles, texts = [None, "user", "assistant", "system", "tool", "", "usher", "ärger"], [None, "", "a.", "b!", "c", "d. ", "\x0be?\n", " ", "x.y", "é"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts), 1, "x") for _ in range(900)]
    rows.append((99, 1, "user", "long " * 300_000 + ".", 1, "x"))
    rows.append((None, None, None, None, None, None))
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("large", [0, 100, 10**9])
def test_chunks_and_parts_agree_with_one_fold(spark, monkeypatch, large):
    """All conversations in chunks, the large ones only, and none."""
    monkeypatch.setattr(conversations, "CHUNK", 4)
    monkeypatch.setattr(conversations, "LARGE", large)
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    spark.conf.set(keys[1], "13")
    rng = random.Random(5)
    roles, texts = [None, "user", "assistant", "system", "tool"], ["", "a.", "b!", "c", "d. "] + [f"{i}." for i in range(300)]
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(150)]), rng.choice(roles), rng.choice(texts), 1, "x") for _ in range(700)]
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert conversations._chunks(conversations.damage(df)).where("conv_id = 1").select("_part").distinct().count() > 1
        assert found(df) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_turn_numbers_too_far_apart(spark):
    df = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    row = conversations.repair(df).first()
    assert row.gaps is None and row.audit == "KK" and [tuple(t) for t in row.repaired] == [("user", "a."), ("assistant", "b.")]


@pytest.mark.parametrize(("turns", "audit", "cost"), [("u", "KI", 2), ("s", "D", 3), ("aa", "IKIK", 4), ("uu", "KR", 2), ("sua", "KKK", 0), ("x", "D", 3), ("uau", "KKD", 3)])
def test_audits_by_hand(spark, turns, audit, cost):
    rows = [(1, i, {"u": "user", "a": "assistant", "s": "system", "x": "x"}[t], f"{i}.") for i, t in enumerate(turns)]
    row = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    want = solved([r[1:] for r in rows])
    assert (row.audit, row.cost) == (want["audit"], want["cost"]) and row.cost <= cost and len(row.audit) >= len(turns)
    assert row.audit == audit or row.cost < cost or row.audit < audit


def test_one_shuffle_of_texts(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = conversations.repair(conversations.damage(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_no_python_runs(spark):
    plan = conversations.damage_and_repair(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == {} and conversations.repair(df.select("conv_id", "turn", "role", "text")).where(F.lit(True)).count() == 0
