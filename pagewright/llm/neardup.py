"""MinHash near-dedup with tensored banding.

A text's set is its distinct 5-word shingles. Instead of 400 minhashes for 100 tables of four, 40 minhashes make two
collections of ten half keys (two minhashes each), and every half key of the first is combined with every one of the
second: 100 table keys. A half key that no other set has rules out ten tables at once, so keys are only formed from
shared halves. At similarity 0.75 a pair is missed with probability 2 * (1 - 0.75**2)**10, about 0.0005.

Links are confirmed on full sets. In each table key, all sets are compared with a representative; what that links is
one component. Where a key still holds several components, all pairs across them are compared in blocks, so no link
between sets that share a key is lost, and no group is held whole or expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blocks import saved, thrifty
from pagewright.llm.words import chunks, flat, mix, row_ends, run_hashes, spans, word_hashes

SHINGLE = 5
HALVES = 10
TOGETHER = 2
SIMILARITY = 75
BLOCK = 512


def shingle_sets(texts: pa.Array, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the offsets of the texts in them.

    A-Z are lower-cased. A text with fewer than ``words`` words has one shingle, the whole sequence; without words, none.
    """
    buf, at = flat(texts)
    start, end, first = spans(buf, at)
    h = word_hashes(buf, start, end, lower=True)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    offset = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offset[-1], np.uint64)
    runs = run_hashes(h, words)
    out[np.repeat(n >= words, count)] = runs[np.arange(words, len(h) + 1) <= row_ends(first)[: len(runs)]]
    for d in np.flatnonzero((n > 0) & (n < words)):
        out[offset[d]] = mix(run_hashes(h[first[d] : first[d + 1]], int(n[d])) + np.uint64(n[d]))[0]
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offset[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offset]


def half_keys(sets: np.ndarray, offset: np.ndarray, halves: int = HALVES, together: int = TOGETHER, piece: int = 1 << 15) -> np.ndarray:
    """texts x (2 * halves) keys, each of ``together`` minhashes; the texts must not have empty sets."""
    n = 2 * halves * together
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    addend = mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))
    low = np.empty((n, len(offset) - 1), np.uint64)
    a = 0
    while a < len(offset) - 1:
        b = max(a + 1, int(np.searchsorted(offset, offset[a] + piece, "right")) - 1)
        part, cut = sets[offset[a] : offset[b]], offset[a:b] - offset[a]
        for i in range(n):
            low[i, a:b] = np.minimum.reduceat(part * factor[i] + addend[i], cut)
        a = b
    keys = np.tile(np.arange(2 * halves, dtype=np.uint64)[:, None], low.shape[1])
    for t in range(together):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[t::together])
    return keys.T


def fingerprints(sets: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """16 bytes for each non-empty set: two sums of its mixed shingles."""
    both = [np.add.reduceat(mix(sets ^ np.uint64(salt)), offset[:-1]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.stack(both, axis=1)


def signatures(df: DataFrame, doc_id: str, text: str, shingle: int, halves: int, together: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, halves): node is the set's fingerprint, null without shingles."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), F.col(text).alias("text"))

    @thrifty
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, piece in chunks(batch["text"]):
                sets, offset = shingle_sets(piece, shingle)
                n = np.diff(offset)
                full = np.flatnonzero(n)
                node, keys = np.full(len(n), None, object), np.full(len(n), None, object)
                if len(full):
                    own = np.append(offset[:-1][full], offset[-1])
                    node[full] = [x.tobytes() for x in fingerprints(sets, own)]
                    keys[full] = list(half_keys(sets, own, halves, together).view(np.int64))
                part = batch.slice(row, len(n))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_key"], pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_shingles", "node", "halves"],
                )

    null = F.lit(None)
    schema = rows.select("doc_id", "text_key", null.cast("long").alias("n_shingles"), null.cast("binary").alias("node"), null.cast("array<long>").alias("halves")).schema
    return rows.mapInArrow(sign, schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node that it reaches.

    Large-star and small-star rounds: all edges of a node move to its smallest neighbour, until every node hangs on the
    smallest of its component. Each round is written out, and the edges of a node meet its minimum in a join that
    adaptive execution can split, so a node with very many edges is no single task's work.
    """
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "lows")
        moved = both.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"), F.col("u").alias("w"))
        if large:
            out = moved.where("u > w").select("u", "v")
        else:
            out = moved.select("u", "v").unionByName(low.select("u", F.col("low").alias("v")))
        return saved(out.where("u <> v").distinct(), "edges")

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        edges = star(star(edges, True), False)
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The (node, rep) pairs whose full sets are similar enough. Rows stream by; only one representative is held."""
    rows = (
        pairs.join(texts.select("node", "text"), "node")
        .join(texts.select(F.col("node").alias("rep"), F.col("text").alias("rep_text")), "rep")
        .select("node", "rep", "text", "rep_text")
    )

    @thrifty
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rep_set = None, None
        for batch in batches:
            for row, piece in chunks(batch["text"]):
                sets, offset = shingle_sets(piece, shingle)
                part = batch.slice(row, len(piece))
                keep = []
                for i, rep in enumerate(part["rep"].to_pylist()):
                    if rep != held:
                        held, rep_set = rep, shingle_sets(part["rep_text"].slice(i, 1), shingle)[0]
                    keep.append(similar(sets[offset[i] : offset[i + 1]], rep_set, percent))
                yield part.select(["node", "rep"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(compare, "node binary, rep binary")


def across(members: DataFrame, texts: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """(a, b) links between roots, from comparing all pairs of a group's nodes that have different roots.

    members: (node, root, group_id). Nodes are dealt into blocks of about ``block`` by root, a large root into several.
    Pairs of blocks of one group are tasks of their own, except where both hold the same single root.
    """
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    roots = members.groupBy("group_id", "root").agg(F.count(F.lit(1)).alias("m"))
    dealt = (
        members.join(sizes, "group_id").join(roots, ["group_id", "root"])
        .withColumn("block", F.struct(F.pmod(F.xxhash64("root"), F.ceil(F.col("n") / block)).alias("p"), F.pmod(F.xxhash64("node", "root"), F.ceil(F.col("m") / block)).alias("q"), F.when(F.col("m") > block, F.col("root")).alias("r")))
        .select("group_id", "block", "node", "root")
    )
    dealt = saved(dealt, "near-blocks")
    blocks = dealt.groupBy("group_id", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = blocks.select("group_id", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = (
        blocks.join(other, "group_id")
        .where((F.col("block") < F.col("block2")) | (F.col("block") == F.col("block2")))
        .where("NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
        .select("group_id", "block", "block2", F.xxhash64("group_id", "block", "block2").alias("task"))
    )
    pairs = saved(pairs, "near-tasks")
    sides = pairs.select("group_id", "task", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    rows = sides.join(dealt, ["group_id", "block"]).join(texts.select("node", "text"), "node").select("task", "node", "root", "text")

    def compare(table: pa.Table) -> pa.Table:
        sets, offset = shingle_sets(table["text"].combine_chunks(), shingle)
        n, size = table.num_rows, np.diff(offset)
        row = np.repeat(np.arange(n), size)
        values, code, count = np.unique(sets, return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        row, code = row[shared[code]], number[code[shared[code]]]
        by_code = np.argsort(code, kind="stable")
        row, code = row[by_code], code[by_code]
        common = np.zeros((n, n), np.float32)
        width = 4096
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(code, [lo, lo + width])
            has = np.zeros((n, width), np.float32)
            has[row[a:b], code[a:b] - lo] = 1
            common += has @ has.T
        root = {r: i for i, r in enumerate(dict.fromkeys(table["root"].to_pylist()))}
        label = np.array([root[r] for r in table["root"].to_pylist()])
        union = size[:, None] + size[None, :] - common
        x, y = np.nonzero(np.triu((100 * common >= percent * union) & (label[:, None] != label[None, :]), 1))
        _, one = np.unique(label[x].astype(np.int64) * n + label[y], return_index=True)  # a link between two roots is enough
        return pa.table({"a": table["root"].take(pa.array(x[one])), "b": table["root"].take(pa.array(y[one]))})

    return rows.groupBy("task").applyInArrow(compare, "a binary, b binary")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
    shingle: int = SHINGLE, halves: int = HALVES, together: int = TOGETHER, percent: int = SIMILARITY, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= percent * union of their shingle sets. component_id is the smallest
    doc_id that a row reaches over links, itself included (null if none of those rows has one); kept says that this
    is the row's own. Texts without words, and null, are linked with nothing. Rows with equal sets are one node, so
    repeated rows cost nothing; rows that repeat a doc_id share its component's decision. Comparisons of doc_id use
    its own order. An empty table gives no rows. Other columns are not needed and may have any names.
    """
    rows = saved(signatures(df, doc_id, text, shingle, halves, together), "signatures")
    nodes = saved(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low_id"), F.min("text_key").alias("text_key"), F.first("halves").alias("halves")), "near-nodes")
    slots = nodes.select("node", F.posexplode("halves").alias("slot", "half"))
    twice = saved(slots.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves")
    shared = slots.join(twice, "half", "left_semi")
    tensor = shared.groupBy("node").agg(
        F.collect_list(F.when(F.col("slot") < halves, F.col("half"))).alias("left"), F.collect_list(F.when(F.col("slot") >= halves, F.col("half"))).alias("right")
    )
    keys = saved(tensor.select("node", "right", F.explode("left").alias("x")).select("node", "x", F.explode("right").alias("y")).select("node", F.xxhash64("x", "y").alias("key")), "table-keys")
    order = F.struct(F.xxhash64("node", F.pmod("key", F.lit(2))).alias("h"), F.col("node").alias("rep"))
    reps = saved(keys.groupBy("key").agg(F.min(order).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "r.rep"), "representatives")
    pairs = saved(keys.join(reps, "key").where("node <> rep").select("node", "rep").distinct(), "near-pairs")
    wanted = saved(pairs.select(F.explode(F.array("node", "rep")).alias("node")).distinct().join(nodes.select("node", "text_key"), "node"), "near-wanted")
    whole = df.select(F.unhex(F.md5(text)).alias("text_key"), F.col(text).alias("text")).where("text_key is not null").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = saved(wanted.join(whole, "text_key").select("node", "text"), "near-texts")
    linked = saved(confirmed(pairs, texts, shingle, percent), "links")
    roots = saved(components(linked, "node", "rep"), "roots")
    labelled = keys.join(reps.select("key"), "key", "left_semi").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    labelled = saved(labelled, "labelled")
    mixed = saved(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("head")).where("lo <> hi").select("key", "head"), "mixed-keys")
    rest = saved(labelled.join(mixed, "key").select("node", "root", "head").distinct(), "unresolved")
    grouped = saved(components(rest, "node", "head"), "groups").select("node", F.col("root").alias("group_id"))
    members = rest.select("node", "root").distinct().join(grouped, "node")
    more = saved(across(members, texts, shingle, percent, block), "more-links")
    final = saved(components(more), "final-roots").select(F.col("node").alias("root"), F.col("root").alias("top"))
    tops = nodes.select("node", "low_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(final, "root", "left").withColumn("top", F.coalesce("top", "root"))
    tops = saved(tops.select("node", "low_id", "top"), "tops")
    lowest = saved(tops.groupBy("top").agg(F.min("low_id").alias("component_id")), "component-ids")
    known = saved(tops.join(lowest, "top").select("node", "component_id"), "known")
    out = rows.join(known, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
