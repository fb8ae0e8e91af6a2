"""Longest blocks of many pairs at once against difflib, one pair at a time."""

import difflib
import random
import time

import pytest

from pagewright.functions import matching
from pagewright.operators import match
from tests.conftest import SF


def by_difflib(a: str, b: str) -> int:
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize("limits", [(1 << 19, 1 << 21), (300, 40)])
def test_shared_characters_are_those_of_difflib(monkeypatch, limits):
    monkeypatch.setattr(matching, "CHARACTERS", limits[0])
    monkeypatch.setattr(matching, "BLOCKS", limits[1])
    r = random.Random(7)
    text = lambda letters: "".join(r.choice(letters) for _ in range(r.choice([0, 1, 4, 40, 90])))
    pairs = [("", ""), ("a", ""), ("", "b"), ("same", "same")]
    for letters in ["a", "ab", "abcdefghij", "a😀é日"] * 15:
        a, b = text(letters), text(letters)
        pairs += [(a, b), (a * 3, b * 2 + a), (a + b, a[1:] + "#" + b[2:])]
    assert matching.shared(pairs).tolist() == [by_difflib(a, b) for a, b in pairs]
    assert matching.shared([]).tolist() == []


def test_a_long_line_takes_seconds():
    """20,000 equal characters took difflib over half a minute, and lines of 60,000 are in the tables."""
    began = time.time()
    assert matching.shared([("a" * 20_000, "a" * 9_000 + "b" + "a" * 9_000)]).tolist() == [18_000]
    assert time.time() - began < 10


def test_line_differences_works_out_no_distances(spark):
    """The rows are those of accuracy < 100, but the quadratic distance of long lines isn't needed to tell."""
    from pagewright.plans import tokens

    plan = tokens.line_differences(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower()


def test_greedy_matching_is_one_walk(spark):
    """Rounds were written and joined until nothing was left; settled apart by type, the choice is the same."""
    pairs = spark.createDataFrame([(1, "t", "a", "x", 0.9), (1, "t", "a", "y", 0.9), (1, "t", "b", "x", 0.9), (1, "t", "b", "y", 0.1), (1, "u", "c", "z", 0.5), (2, "t", "a", "x", 0.2)], "page int, type string, a string, b string, s double")
    for within in ([], ["type"]):
        won = match.greedy_match(pairs, ["page"], "a", "b", "s", 0.1, within)
        assert "FileScan" not in won._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in won.collect()) == [(1, "t", "a", "x", 0.9), (1, "t", "b", "y", 0.1), (1, "u", "c", "z", 0.5), (2, "t", "a", "x", 0.2)]
