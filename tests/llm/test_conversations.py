"""Conversation repair against a search over single edits, on real and on random conversations."""

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest

from pagewright.llm import conversations, queries
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, audit string, conv string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for row in rows:
        solid = BLANK.findall(row[1])
        out.append("blank" if not solid else "duplicate" if row in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add(row)
    return out


def brute(rows):
    """Cheapest edits by Dijkstra over (edits so far), least edits first; initials so far must begin some right order."""
    found = faults(rows)
    begins = re.compile(r"(s?(ua)*u?)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, out
        if (i, roles[-1:], len(roles) > 0, roles == "s") in done:
            continue
        done.add((i, roles[-1:], len(roles) > 0, roles == "s"))
        steps = [(2, "I", i, r, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            steps.append((3, "D", i + 1, "", None))
            if found[i] not in ("blank", "duplicate"):
                extra = int(found[i] == "truncated")
                steps += [(extra, "K", i + 1, rows[i][0][:1] or "?", rows[i])] + [(2 + extra, "R", i + 1, r, (r, rows[i][1])) for r in ("user", "assistant")]
        for c, e, j, r, row in steps:
            new = roles + r[:1]
            if begins.fullmatch(new):
                heapq.heappush(heap, (cost + c, audit + e, j, new, out + ((row,) if row else ())))
    raise AssertionError


def summary(turned):
    """turned: (turn, role, text) rows without nulls but in turn."""
    turned = sorted(turned, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    rows = [r[1:] for r in turned]
    turns = [r[0] for r in turned if r[0] is not None]
    f = faults(rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = brute(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def got(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def random_rows(seed, n=160):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", "unit", None]
    texts = ["Hello.", "What?", "no end", "", " \n", "Wow! ", None, " ", "x.\x1f", "end. "]
    out = []
    for c in range(n):
        for t in range(int(rng.integers(0, 9))):
            out.append((c if c else None, None if rng.random() < 0.05 else int(t * rng.integers(1, 3)), roles[rng.choice(7, p=[0.35, 0.3, 0.1, 0.1, 0.05, 0.05, 0.05])], texts[rng.integers(len(texts))]))
    return out


@pytest.mark.parametrize("segment, parts", [(2048, 3), (3, 7), (1, 2)])
def test_random_conversations(spark, segment, parts):
    rows = random_rows(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = got(conversations.repair(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), segment_rows=segment))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    real = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert out == {c: summary(g) for c, g in grouped(real).items()}


def test_query_is_the_search_over_damaged_rows(spark):
    rows = [tuple(r) for r in queries.read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    out = got(queries.op11_conversation_repair(spark, SF))
    left = grouped(damage(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == {c: summary(left[c]) if c in left else none for c in {r[0] for r in rows}}


def test_matrices_agree_with_the_search_whatever_the_grammar():
    rng = np.random.default_rng(6)
    for _ in range(150):
        marks = "".join(rng.choice(list(conversations.TERMINALS), rng.integers(0, 12)))
        rules = []
        for i in range(int(rng.integers(0, 6))):
            known = list(conversations.TERMINALS) + [r[0] for r in rules]
            rules.append((chr(0x100 + i), "".join(rng.choice(known, 2))))
        [row] = conversations.cheapest(marks, conversations.matrices(rules), rules, (conversations.START,))
        ends = [(x[0] + 2 * len(t), conversations.text_of(x[1]) + t) for x, t in zip(row, conversations.ENDS.values()) if x is not None]
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        rows = [(roles[m.lower()], " " if m == "X" else f"{i}." if m.islower() else f"{i}") for i, m in enumerate(marks)]
        assert min(ends) == brute(rows)[:2]


def test_long_conversations_and_texts(spark):
    rng = np.random.default_rng(3)
    long = "word " * 600_000 + "end."
    rows = [(5, i, ["user", "assistant"][i % 2], f"text {rng.integers(40)}.") for i in range(700)] + [(9, 0, "user", long), (9, 1, "assistant", "x" * 2_000_000), (5, None, "system", "First.")]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    out = got(conversations.repair(frame, segment_rows=50))
    assert out == {c: summary(g) for c, g in grouped(rows).items()} == got(conversations.repair(frame, segment_bytes=100))
    kept = conversations.repair(frame).where("conv_id = 5").collect()[0]
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept.repaired).encode()).hexdigest() == kept.repaired_sha256
    assert conversations.repair(frame.limit(0)).count() == 0


def test_a_rule_stands_for_its_pair(spark):
    patterns = spark.createDataFrame([("uauaua", 4), ("uaX", 2), ("uuuuu", 3), ("s", 9)], "marks string, n long")
    rules = conversations.grammar(patterns)
    table = conversations.matrices(rules)
    assert rules and rules[0][1] == "ua"
    for marks in ("uauaua", "uaX", "uuuuu"):
        assert len(conversations.compressed(marks, rules)) < len(marks)
        plain, short = conversations.cheapest(marks, table, []), conversations.cheapest(marks, table, rules)
        flat = lambda m: [[None if x is None else (x[0], conversations.text_of(x[1])) for x in row] for row in m]
        assert flat(plain) == flat(short)
