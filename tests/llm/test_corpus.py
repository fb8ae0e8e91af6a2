"""Dedup, mixing, language, decontamination and language-model operators against brute force and on odd inputs."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import decontam, langid, lm, mixing, neardup, queries, substrings
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Word string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def corpus():
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    base, shared = say(120), say(40)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \t\n", "One", "one", "a b c d", "A B c d", base, base, " ".join(near), say(80) + " " + shared + " " + say(30), shared + "\n" + say(50),
        "x " * 300, say(3000), "12 34 !!", "Straße ÄÖ   é", say(60),
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], None, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[16], (None, "no id at all", "en", None, None, None), (3, "One", "en", "a", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def brute_repeats(texts, window):
    count = Counter(tuple(w[i : i + window]) for w in map(words, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(words, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window, prefix", [(35, 16), (9, 4), (5, 5)])
def test_repeats_are_those_of_brute_force(spark, docs, window, prefix):
    got = substrings.remove_repeats(docs, window=window, prefix=prefix).collect()
    want = brute_repeats([r[1] for r in corpus()], window)
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(want)
    assert {r.Word for r in got} == {"clash", None}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_groups_on_random_texts():
    rng = np.random.default_rng(0)
    for trial in range(60):
        texts = [" ".join(map(str, rng.integers(0, rng.integers(1, 6), rng.integers(0, 60)))) for _ in range(rng.integers(1, 6))]
        s = substrings.BlockSuffixes(pa.array(texts), 9, 4)
        windows = s.below(s.again)
        _, count, node = s.nodes(windows)
        gone = s.covered(windows[(count > 1)[node]])
        assert [x for x in substrings.kept_words(pa.array(texts), ~gone).to_pylist()] == [t for _, _, t in brute_repeats(texts, 9)], trial


def test_nodes_that_share_a_hash_stay_apart():
    high, low = np.array([5, 5, 1, 5, 5], np.uint64), np.array([7, 8, 7, 7, 9], np.uint64)
    order, new = substrings.ranked(high, low)
    assert new.sum() == 4 and [(int(high[i]), int(low[i])) for i in order] == [(1, 7), (5, 7), (5, 7), (5, 8), (5, 9)]


def brute_components(rows, percent=75):
    sets = []
    for r in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((r[0], len(sets[i]), low, r[0] == low))
    return out


def test_near_duplicates_are_those_of_brute_force(spark, docs):
    key = lambda t: tuple((x is None, x or 0) for x in t)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_components(corpus()), key=key)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_chains_across_small_blocks_keep_every_link(spark):
    """Each text is like its neighbours only; blocks of two nodes force many pairs of blocks."""
    rng = np.random.default_rng(1)
    w = [f"v{x}" for x in rng.integers(0, 10**6, 100)]
    rows = []
    for i in range(24):
        rows.append((i, " ".join(w), None, None, None, None))
        w = [*w[2:], f"n{2 * i}", f"n{2 * i + 1}"]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute_components(rows))


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, {a})
            root.setdefault(b, {b})
            if root[a] is not root[b]:
                root[a] |= root[b]
                for x in root[b]:
                    root[x] = root[a]
    assert got == {n: min(c) for n, c in root.items()}


def test_mix_keeps_its_promises(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    total = sum(len(words(r[1])) for r in corpus())
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert len([s for s in r.shards.split(",") if s]) == math.ceil(r.taken / r.size) if r.size else r.shards == ""
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        assert sum(r.taken for r in rows) == math.floor(rows[0].target + 0.5)
        assert rows[0].target <= 3 * rows[0].source_size and sum(r.size for r in rows) == rows[0].source_size
    assert abs(sum(rows[0].target for rows in by_source.values()) - total) < 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("size(split(text, ' ')) < 0")).collect()} == set()


def test_excess_is_shared_again_until_nothing_is_above(spark):
    sizes = [("a", 1), ("b", 10), ("c", 1000), (None, 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    total, share, weight = 1011, {}, {"a": 1, "b": 2, "c": 3, None: 1}
    capped = set()
    while True:
        rest = total - sum(3 * n for s, n in sizes if s in capped)
        free = sum(weight[s] for s, _ in sizes if s not in capped)
        share = {s: 3.0 * n if s in capped else rest * weight[s] / free for s, n in sizes}
        over = {s for s, n in sizes if s not in capped and share[s] > 3 * n}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(share)


def test_shards_get_each_draw_once(spark, docs):
    rows, mixed = mixing.shard_rows(docs).collect(), mixing.mix(docs).collect()
    assert sum(r.mix_words for r in rows) == sum(r.taken for r in mixed)
    drawn = Counter((r.row.doc_id, r.row.text, r.mix_shard) for r in rows)
    own = Counter()
    for m in mixing.mix(docs, whole_rows=True).collect():
        own.update((m.doc_id, m.row.text, int(s)) for s in m.shards.split(",") if s)
    assert drawn == own and {r.row.Word for r in rows} <= {"clash", None}
    for r in rows:
        assert r.mix_text == r.row.text or words(r.mix_text) == words(r.row.text)[: r.mix_words]
    assert mixing.shard_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bins", [1, 4, 4096])
def test_tree_cuts_each_node_in_the_middle(spark, bins):
    numbers = [(s, i) for s, n in (("a", 40), ("b", 7), ("", 1)) for i in range(1, n + 1)]
    told = mixing.quotas(spark.createDataFrame(numbers, "source_key string, number int"), 3, 1, bins).collect()
    shards, sources = Counter(), Counter()
    for r in told:
        shards[r.shard] += r.quota
        sources[r.source_key] += r.quota
    assert sources == {"a": 40, "b": 7, "": 1} and sorted(shards.values()) == [6] * 8


def test_left_quotas_are_hypergeometric(spark):
    left = []
    for seed in range(12):
        told = mixing.quotas(spark.createDataFrame([(s, i) for s in "ab" for i in range(200)], "source_key string, number int"), 1, seed).where("source_key = 'a' AND shard = 0").first()
        left.append(told.quota)
    spread = 200 * 200 * 200 * 200 / (400 * 400 * 399)  # variance of 200 out of 400 with 200 of the kind
    assert abs(np.mean(left) - 100) < 4 * math.sqrt(spread / 12) and 0.2 * spread < np.var(left) < 3 * spread


def test_running_sums_over_ranges(spark):
    values = [(i * 7919 % 101, i % 5) for i in range(101)]
    got = mixing.in_order(spark.createDataFrame(values, "k int, v long"), [F.col("k")], "v").collect()
    for r in got:
        assert r["at"] == r.k + 1 and r.before_v == sum(v for k, v in values if k < r.k)


def key_counts(rows):
    return Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in rows)


def test_base_scores_and_counts(spark, docs):
    rows = corpus()
    train = [r for r in rows if r[0] is not None and r[0] % 2 == 0]
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)]
    count = Counter(w for r in train for w in low(r[1]))
    count[None] = len(train)
    n, v = sum(count.values()), len(count)
    got = lm.score_texts(docs, F.col("doc_id") % 2 == 0).collect()
    want = []
    for r in rows:
        tokens = [*low(r[1]), None]
        want.append((len(tokens), sum(count[t] > 0 for t in tokens), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    key = lambda t: (t[0], t[1], round(t[3], 6))
    for g, w in zip(sorted(((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-6)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({(r.text, round(r.score, 9)) for r in got}) == len({r.text for r in got})
    slim = lm.score_texts(docs, F.col("doc_id") % 2 == 0, keep_text=False)
    assert "text" not in slim.columns and key_counts(slim.collect()) == key_counts(got)
    untrained = lm.score_texts(docs, F.lit(False)).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in untrained} == {(0, 0.0, 0)}
    assert lm.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_repeated_words_score_better_than_strange_ones(spark):
    rows = [(i, "red green blue " * 20, None, None, None, None) for i in range(20)] + [(99, "blue red green", None, None, None, None), (98, "qxz vvk jjw", None, None, None, None)]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 20).where("doc_id > 20").collect()}
    assert got[99] > got[98] + 5


def brute_scores(texts, train, reach, divergence):
    """Contexts of words counted, tested and scored one by one: (log10 probabilities, kept contexts, their distribution)."""
    ways = [[("start",), *[("word", w) for w in words(t.lower())], ("end",)] for t in texts]
    learnt = [w for w, own in zip(ways, train) if own]
    seen = [{(): Counter(t for way in learnt for t in way[1:])}]
    size, kinds = seen[0][()].total(), len(seen[0][()])
    for d in range(1, reach + 1):
        seen.append({})
        for way in learnt:
            for i in range(d, len(way)):
                seen[d].setdefault(tuple(way[i - d : i]), Counter())[way[i]] += 1
    kept = {}

    def p(past, token, longest):
        for d in range(min(longest, len(past)), 0, -1):
            if past[-d:] in kept:
                n, spare, total = kept[past[-d:]]
                return (n[token] + spare * p(past, token, d - 1)) / total
        return (seen[0][()][token] + 0.5) / (size + 0.5 * (kinds + 1))

    for d in range(1, reach + 1):
        for c, n in seen[d].items():
            shorter = seen[d - 1][c[1:]]
            if n.total() < 2 or (d > 1 and shorter.total() == n.total()):
                continue
            strong = Counter({t: k for t, k in n.items() if shorter[t] >= 2})
            rare = n.total() - strong.total()
            spare, total = len(strong) + rare, n.total() + len(strong)
            gain = sum(k * math.log(k / total / p(c, t, d - 1)) for t, k in strong.items()) + (rare * math.log(spare / total) if rare else 0)
            if gain >= divergence:
                kept[c] = (strong, spare, total)
    return [sum(math.log10(p(tuple(way[max(0, i - reach) : i]), way[i], reach)) for i in range(1, len(way))) for way in ways], kept, p


@pytest.mark.parametrize("hot", [1 << 22, 7])
def test_contexts_cross_words_as_in_brute_force(spark, hot):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 40, n))
    passage = say(50)
    often = " ".join(f"the v{x}" for x in rng.integers(0, 30, 200))
    texts = ["", *[say(int(n)) for n in rng.integers(1, 60, 60)], often, passage, say(9) + " " + passage, " ".join(sorted(passage.split())), "never seen " + passage]
    train = [i % 5 != 1 and i < len(texts) - 2 or texts[i] == often for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in lm.score_texts(frame, F.element_at(F.array(*map(F.lit, train)), F.col("doc_id").cast("int") + 1), divergence=1.0, hot=hot).collect()}
    want, kept, p = brute_scores(texts, train, 3, 1.0)
    assert {len(c) for c in kept} == {1, 2, 3}
    assert max(v[2] for v in kept.values()) > 21  # some are spread over groups
    assert [got[i] for i in range(len(want))] == pytest.approx(want, abs=1e-6)
    assert got[len(texts) - 4] > got[len(texts) - 2] + 10  # the same words sorted
    every = {("end",), *[("word", w) for t, own in zip(texts, train) if own for w in words(t)], ("word", "never")}
    for c in list(kept)[::20]:
        assert sum(p(c, t, 3) for t in every) == pytest.approx(1)


def test_held_out_texts_of_known_words_beat_the_base(spark):
    got = queries.op9_lm_scoring(spark, SF).collect()
    known = [r for r in got if r.held_out and r.n_known == r.n_tokens and r.n_tokens > 1]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_held_out_languages_are_right(spark):
    truth = {r.doc_id: r.lang for r in queries.read(spark, SF, "documents").collect()}
    got = queries.op4_language_id(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_texts_without_letters_have_no_language(spark, docs):
    got = langid.identify(docs, F.lit(True)).collect()
    assert len(got) == len(corpus())
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "de")) == lettered and (r.lang_pred == "und") == (not lettered)
    nothing = langid.identify(docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_windows_cover_whole_texts():
    texts = ["", "abc", "x" * 1000, "é" * 200]
    from pagewright.llm.words import flat

    windows, own, held = langid.text_windows(*flat(pa.array(texts)), 192)
    for i, t in enumerate(texts):
        assert b"".join(windows[k, : held[k]].tobytes() for k in np.flatnonzero(own == i)) == t.encode()


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    x = np.where(np.arange(200)[:, None] % 2 == 0, rng.integers(97, 105, (200, 64)), rng.integers(103, 112, (200, 64))).astype(np.uint8)
    net = langid.train_net(x, np.arange(200) % 2, ["a", "b"])
    high, _ = langid.pooled(x, net.tables())
    p = langid.softmax(np.maximum(high + net.bias, 0) @ net.dense + net.shift)
    assert (p.argmax(1) == np.arange(200) % 2).mean() > 0.95


ITEM = "The quick silver wombat measured eleven copper kettles before breakfast and wrote every single number into a very small green notebook"


def test_leaks_and_paraphrases_are_found(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join(f"z{x}" for x in rng.integers(0, 400, n))
    changed = ITEM.replace("silver", "golden").replace("single", "last").replace("eleven", "several")
    texts = [None, "", noise(200), noise(90) + " " + ITEM + " " + noise(500), ITEM.upper(), noise(33) + " " + changed, " ".join(reversed(ITEM.split())), noise(7) + "\n" + ITEM.replace(" ", "###  ") + "," + noise(7), "the and every very"]
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)] * 2, SCHEMA)
    items = spark.createDataFrame([(7, ITEM), (8, " ".join(f"q{i}" for i in range(150))), (9, None), (None, "x"), (7, ITEM)], "item_id long, text string")
    rows = decontam.find_leaks(docs, items).collect()
    assert sorted(r.doc_id for r in rows if r.leaks) == [3, 3, 4, 4, 5, 5, 7, 7]
    assert all(x.item_id == 7 and 0.6 <= x.lcs_share <= 1 for r in rows for x in r.leaks)
    assert decontam.find_leaks(docs.limit(0), items).count() == 0
    assert all(not r.leaks for r in decontam.find_leaks(docs, items.limit(0)).collect())


def test_no_leak_is_lost_to_the_cosine(spark):
    rng = np.random.default_rng(9)
    noise = lambda n, of: " ".join(f"{of}{x}" for x in rng.integers(0, 5000, n))
    common, long = [f"c{i}" for i in range(16)], [f"q{i}" for i in range(72)]
    copies = [noise(8, "rare") + " " + " ".join(common) + " " + noise(8, "rare") for _ in range(40)]
    part = " ".join(w if i % 5 < 3 else f"{noise(1, 'r')} {noise(1, 'r')}" for i, w in enumerate(long))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*copies, part, noise(300, "z"), " ".join(common[::-1])])], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(common)), (2, " ".join(long))], "item_id long, text string")
    for gate in (decontam.COSINE, 2.0):
        got = {(r.doc_id, x.item_id) for r in decontam.find_leaks(docs, items, cosine=gate).collect() for x in r.leaks}
        assert got == {*((i, 1) for i in range(40)), (40, 2)}


def test_latent_space_is_fitted_on_every_document(spark):
    rng = np.random.default_rng(2)
    texts = ["", *[" ".join(f"v{x}" for x in rng.integers(0, 60, n)) for n in rng.integers(1, 90, 60)]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    items = spark.createDataFrame([(i, " ".join(f"v{x}" for x in rng.integers(0, 40, 20))) for i in range(24)], "item_id long, text string")
    blocks = decontam.hashed_rows(docs, "text")
    passages, idf = decontam.item_passages(items, "item_id", "text"), decontam.inverse_frequencies(blocks)
    got = decontam.latent_space(blocks, passages, idf)

    def vector(ws):
        v, norm = np.zeros(decontam.COLUMNS), 0
        for h in ws:
            norm += idf[decontam.bucket(h)] ** 2
            v[decontam.column(h)] += idf[decontam.bucket(h)]
        return v, norm

    own = np.array([vector(p.words)[0] for p in passages])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    h, first = decontam.hashed(pa.array(texts))
    every = [vector(h[i : min(i + 24, b)]) for a, b in zip(first, first[1:]) for i in range(a, b, 12)]
    a = np.vstack([own, *[v / math.sqrt(n) * math.sqrt(len(own) / len(every)) for v, n in every]])
    assert got.basis.shape == (decontam.COLUMNS + 1, len(own) // 2)
    q, _ = np.linalg.qr(a.T @ (a @ np.random.default_rng(3).normal(size=(decontam.COLUMNS, len(own) // 2))))
    want = q @ (q.T @ own.T)
    latent = got.basis[:-1] @ got.items
    assert np.abs((latent / np.linalg.norm(latent, axis=0) * want / np.linalg.norm(want, axis=0)).sum(axis=0) - 1).max() < 1e-3


def brute_leaks(texts, items):
    """Every place of every text against every passage of every item."""
    found = set()
    for d, (t, (i, item)) in ((d, pair) for d, pair in enumerate(((t, x) for t in texts for x in items))):
        h, w = decontam.hashed(pa.array([t]))[0].tolist(), decontam.hashed(pa.array([item]))[0].tolist()
        for a in range(0, max(1, len(w) - 24), 24):
            p = decontam.Passage(i, tuple(w[a : a + 48]), max(1, len(w[a : a + 48]) // 4))
            n = len(p.words)
            if any(decontam.verdict(p, h[max(0, c - n) : c + 24 + n]) for c in range(0, len(h), 12)):
                found.add((d // len(items), i))
    return found


def test_paraphrases_are_those_of_brute_force(spark):
    rng = np.random.default_rng(12)
    say = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 3000)
    items = [(i, say(int(n))) for i, n in enumerate([5, 15, 30, 47, 48, 49, 60, 71, 73, 96, 130, 24])]
    texts = [say(300) for _ in range(10)]
    for i, item in items:
        for share in (1.0, 0.85, 0.7, 0.6, 0.5):
            kept = " ".join(w if rng.random() < share else f"u{rng.integers(9999)}" for w in item.split())
            texts.append(f"{say(int(rng.integers(0, 40)))} {kept} {say(20)}")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, x.item_id) for r in decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect() for x in r.leaks}
    assert got == brute_leaks(texts, items) and len(got) > 30


def test_every_item_that_stands_in_a_document_is_found(spark):
    con = duckdb.connect()
    want = set(con.sql(f"SELECT doc_id, item_id FROM '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b WHERE contains(d.text, b.text)").fetchall())
    assert want <= {(r.doc_id, r.item_id) for r in queries.op5_benchmark_decontamination(spark, SF).collect()}


def test_common_length_is_that_of_the_table():
    from pagewright.llm.licenses import common_run

    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 15)).tolist(), rng.integers(0, 5, rng.integers(0, 15)).tolist()
        assert decontam.common_length(a, b) == len(common_run(a, b))


def test_pipeline_keeps_columns_and_acts(spark, docs):
    import corpus_pipeline as p

    out, names = docs, []
    for name, stage in p.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, SF).collect(), docs.schema)
        names.append((name, out.count()))
        assert out.columns == docs.columns
    assert names[0][1] < len(corpus()) and names[1][1] < names[0][1] and names[2][1] == names[1][1]
    final = p.STAGES[-1][1](spark, out, SF).collect()
    assert final and all(r.words > 0 and len(words(r.text)) == r.words for r in final)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(Counter(r.doc_id for r in rows).values()) <= 4
    assert {r.shard for r in rows} == set(range(16))
    assert all(r.words == len(words(r.text)) for r in rows)
