import hashlib
import heapq
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.conversation_repair import CUT, GONE, LETTERS, PLAIN, Layers, damaged, repair, repair_damaged

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Uniform-cost search over (cost, audit), with the roles made so far: rows are (role, text, fault)."""
    state_of = lambda made: "".join(x[:1] for x, _ in made)
    heap, seen = [(0, "", 0, "n", ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in "na":
            assert GRAMMAR.fullmatch(state_of(made))
            return cost, audit, made
        step = lambda c: "u" if c == "u" and state in "nsa" else "a" if c == "a" and state == "u" else "s" if c == "s" and state == "n" else None
        for role in ("user", "assistant"):
            if step(role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", at, step(role[0]), (*made, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if step(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, step(role[:1]), (*made, (role, text))))
                for other in ("user", "assistant"):
                    if step(other[0]):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, step(other[0]), (*made, (other, text))))
    raise AssertionError


def brute(table):
    out = {conv: [] for conv, *_ in table}
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out[conv] += [row, row] if kind == 3 else [row]
    result = set()
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in rows:
            filled = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, made = cheapest(faulty)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        result.add((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return result


def made(spark, table):
    df = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")
    rows = repair_damaged(df.selectExpr("*", "1 AS step", "'x' AS edit")).collect()
    got = {(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(LETTERS), st.sampled_from(["", "", "truncated", "blank"])), max_size=9))
def test_layers_against_search(turns):
    kinds = {"": PLAIN, "truncated": CUT, "blank": GONE}
    layers = Layers(bytes(LETTERS.index(x) for x, _ in turns), bytes(kinds[f] for _, f in turns))
    assert (layers.cost, "".join(e for _, e, _ in layers.edits())) == cheapest([(x, "t", f) for x, f in turns])[:2]


def test_long_conversations_take_little_memory():
    """A stored byte is one that is neither 0 nor full: some ten a turn, however high the cost."""
    n = 20_000
    layers = Layers(bytes(1 for _ in range(n)), bytes(PLAIN for _ in range(n)))  # system turns alone
    assert layers.cost >= 3 * (n - 1) and sum(len(bits) for _, _, bits in layers.made) < 16 * n


@pytest.fixture(scope="module")
def table():
    import random

    dealt = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "What?  ", "é", "one. two", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", None]
    rows = [(conv, None if dealt.random() < 0.1 else dealt.randrange(8) if conv % 2 else turn, dealt.choice(roles[: 3 + conv % 7]), dealt.choice(texts)) for conv in range(60) for turn in range(dealt.randrange(1, 9))]
    return [*rows, (None, 1, "user", "a."), (None, None, "assistant", "b."), (None, 3, "user", "c."), (-5, None, "user", "x."), (-6, 2**62, "user", "y."), (-6, -(2**62), "user", "y.")]


def test_against_brute_force(spark, table):
    assert made(spark, table) == brute(table)


def test_dropped_and_empty(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert made(spark, [(dropped, 0, "user", "Hi.")]) == {(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert made(spark, []) == set()


def test_repaired_turns(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "cut"), (1, 3, "assistant", " "), (2, 0, "robot", "Hm.")]
    report, repaired = repair(spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string"))
    rows = [(r.edit, r.role, r.text) for r in repaired.where("conv_id = 1").orderBy("step").collect()]
    audit, cost, _ = (lambda found: (found[1], found[0], found[2]))(cheapest([("user", "Hi.", ""), ("user", "There?", ""), ("assistant", "cut", "truncated"), ("assistant", " ", "blank")]))
    assert {(r.conv_id, r.cost, r.audit) for r in report.collect()} == {(1, cost, audit), (2, 4, "D")}
    assert [e for e, _, _ in rows] == [e for e in audit if e != "D"] and all(role == "" or role in ("user", "assistant") for _, role, _ in rows)


def test_damage_repeats_rows_where_they_stand(spark):
    twice = next(k for k in range(1000) if zlib.crc32(f"{k}:7".encode()) % 20 == 3)
    df = damaged(spark.createDataFrame([(twice, 7, "user", None)], "conv_id bigint, turn bigint, role string, text string"))
    assert [tuple(r) for r in df.collect()] == [(twice, 7, "user", " ")] * 2
