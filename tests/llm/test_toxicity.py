"""Toxicity: n-grams against a plain spelling, held-out accuracy, odd rows and long texts."""

import numpy as np
import pyarrow as pa

from pagewright.llm import queries, toxicity
from pagewright.llm.words import flat, spans
from tests.conftest import SF

BAD = ["grubling", "snorfish", "vexpate"]


def said(rng, n, bad=0):
    words = ["".join(rng.choice(list("aeioustnrl"), rng.integers(2, 8))) for _ in range(n)]
    for i in rng.choice(n, bad, replace=False):
        words[i] = BAD[rng.integers(3)]
    return " ".join(words)


def bag_of(texts):
    buf, at = flat(pa.array(texts, pa.string()))
    return toxicity.bags(buf, *spans(buf, at))


def test_grams_are_those_of_padded_words():
    b = bag_of(["Ab  cde\nf", None, "", "abcdefgh"])
    count = lambda words: sum(max(0, len(w) + 2 - n + 1) for w in words for n in toxicity.GRAMS)
    assert (b.grams < toxicity.BUCKETS).sum() == count(["ab", "cde", "f", "abcdefgh"]) and list(b.text) == [0, 3, 3, 3, 4]
    same = bag_of(["aB x", "zz ab"])
    first, second = (same.grams[same.word[i] : same.word[i + 1]] for i in (0, 3))
    assert (first == second).all()


def model(spark, rows):
    rng = np.random.default_rng(8)
    texts = [said(rng, int(rng.integers(20, 80)), 3 if i % 4 == 0 else 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, 7), (5, None)], "doc_id long, toxic int")
    return toxicity.detect(docs, labels)


def test_toxic_texts_stand_out_at_any_length_and_misspelt(spark):
    rng = np.random.default_rng(9)
    rows = [(1000 + i, said(rng, 60, 3), None) for i in range(40)] + [(2000 + i, said(rng, 60), None) for i in range(40)]
    long = said(rng, 200_000)
    rows += [(3000, said(rng, 60).replace(" ", " grublingg snorfishe ", 1), None), (3001, long, None), (3002, f"{long} {BAD[0]} {BAD[1]} {said(rng, 10)}", None)]
    rows += [(4000, None, None), (4001, "", None), (4002, " \n", None), (4003, "x" * 3_000_000, None), (None, "no id", None), (4004, rows[0][1], None)]
    got = {r.doc_id: r.score for r in model(spark, rows).collect()}
    assert len(got) == 400 + len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([got[1000 + i] >= 0.7 for i in range(40)]) > 0.9 and np.mean([got[2000 + i] >= 0.7 for i in range(40)]) < 0.1
    assert got[3000] >= 0.7 and got[3002] >= 0.7 > got[3001] and got[4004] == got[1000]
    assert got[4000] == got[4001] == got[4002] < 0.7


def test_pieces_change_no_score(monkeypatch):
    rng = np.random.default_rng(1)
    scores = rng.normal(size=toxicity.BUCKETS + 1).astype(np.float32)
    scores[-1] = 0
    texts = pa.array([said(rng, 900), said(rng, 3), None, said(rng, 200)])
    whole = toxicity.text_odds(texts, scores, -1.0)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 20)
    assert np.allclose(whole, toxicity.text_odds(texts, scores, -1.0), atol=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.detect(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.detect(docs.limit(0), none).count() == 0
    one = toxicity.detect(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()
    assert all(r.score < 0.5 for r in one)


def test_query_names_every_document(spark):
    rows = queries.op12_toxicity(spark, SF).collect()
    assert len(rows) == queries.read(spark, SF, "documents").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
