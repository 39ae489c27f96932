"""Structure repair against a search in order of cost, on rows with every fault."""

from __future__ import annotations

import random
from collections import defaultdict

from tests.llm import brute
from trialframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest string, conv int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def _by_conversation(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, role, text))
    return own


def test_cheapest_edits_of_random_conversations():
    draw = random.Random(5)
    automaton = repair.Determinized()
    for _ in range(3000):
        roles = draw.choices(["system", "user", "assistant", "tool", ""], [2, 5, 5, 1, 1], k=draw.randrange(12))
        rows = [(i, role, draw.choice(["a.", "b.", "c", "d", "e!", " ", f"{i}.", f"{i}", f"{i}?"])) for i, role in enumerate(roles)]
        kinds = {None: 0, "truncated": 1, "blank": 2, "duplicate": 2}
        symbols = bytes(3 * "sua".find(r[1][:1] or "x") % 12 + kinds[f] for r, f in zip(rows, brute.faults(rows), strict=True))
        cost, along = automaton.scan(symbols)
        assert (cost, automaton.trace(symbols, along)) == brute.repaired(rows)[5:7]
    assert len(automaton.vectors) < 100


def test_odd_rows(spark):
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["system", "user", "assistant", "tool", "", None]), draw.choice(["Ja.", "no", "", None, "\t", "so ?\n", f"{t} é."])) for c in range(60) for t in range(draw.randrange(9))]
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(6)]
    rows += [(100, None, "user", "same."), (100, 3, "assistant", "yes."), (100, -5, "user", "x" * 200_000 + ".")]
    rows += [(101, 7, "user", "twice."), (101, 7, "user", "twice.")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired_conversations(_table(spark, rows)).collect()}
    assert got == {c: brute.repaired(brute.damaged(c, own)) for c, own in _by_conversation(rows).items()}


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What"), (1, 2, "user", " "), (2, 0, "user", "")]
    table = _table(spark, rows)
    report = repair.report(table)
    assert sorted(tuple(r) for r in report.collect()) == [(1, 0, 1, 0, 1, 1, 11, "IKDD"), (2, 0, 1, 0, 0, 0, 4, "D")]
    fixed = [tuple(r) for r in repair.repaired(table, report).orderBy("conv_id", "position").collect()]
    assert fixed == [(1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hi.")]
    assert repair.repaired_conversations(_table(spark, [])).collect() == []


def test_one_conversation_holds_all_rows(spark):
    rows = [(9, t, "user" if t % 2 == 0 else "assistant", f"turn {t // 3}.") for t in range(3000)]
    got = repair.repaired_conversations(_table(spark, rows)).collect()
    assert [tuple(r)[1:] for r in got] == [brute.repaired(brute.damaged(9, [r[1:] for r in rows]))]
