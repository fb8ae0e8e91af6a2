"""Substring dedup: words covered by long passages that occur more than once, by prefix-partitioned suffix trees.

The suffixes of all texts, word by word, form a tree; a passage of ``window`` words repeats if and only if it is the
path to an internal node at that depth, so only nodes that deep are built. The tree is grown by prefixes of two
lengths, and only where it branches:

1. Of each window, the suffix with the smallest hash of its first ``prefix`` words stands for it. Equal windows pick
   equal suffixes at equal places, so a window whose suffix's prefix occurs once is a leaf and is left alone.
2. Windows below prefixes that occur again are told apart by their full ``window`` words. A node with two or more
   suffixes at this depth is a repeat, and the union of its windows in a text is a maximal repeated stretch.

At either length, prefixes are dealt by their leading bits into groups that fit into memory. A task sends each prefix
of a block once, with a mark if the block has it again, so a passage that a third of all texts share costs a group one
entry a block. Back come bits, in the order sent. The short prefixes are 64-bit hashes: two different ones that agree
only send some windows to the second step in vain. Nodes are compared by 128 bits, made from three 64-bit hashes of parts
of the window, so different windows agree with a chance of about n*n/2**129 for n of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blocks import load, pack, saved, thrifty
from pagewright.llm.words import chunks, flat, mix, row_ends, run_hashes, sliding, spans, texts_words

WINDOW = 35
PREFIX = 16
FACTORS = np.array([[0xD6E8FEB86659FD93], [0xA0761D6478BD642F]], np.uint64)


class BlockSuffixes:
    """The windows of a block's texts and the prefixes that stand for them."""

    def __init__(self, texts: pa.Array, window: int, prefix: int):
        h, self.first = texts_words(texts)
        self.window, self.n_words = window, len(h)
        reach = window - prefix + 1  # prefixes that lie in one window
        if len(h) < window:
            self.valid, self.leaf = np.zeros(0, bool), np.empty(0, np.uint64)
            self.prefixes, self.again = np.empty(0, np.uint64), np.empty(0, bool)
            return
        g = run_hashes(h, prefix)
        m = len(h) - window + 1
        self.valid = np.arange(window, len(h) + 1) <= row_ends(self.first)[:m]
        self.leaf = sliding(g, reach, np.minimum)
        around = np.zeros(m + 2 * (reach - 1), np.uint64)
        around[reach - 1 : reach - 1 + m] = np.where(self.valid, self.leaf, np.uint64(0))
        self.prefixes, count = np.unique(g[sliding(around, reach, np.maximum) == g], return_counts=True)
        self.again = count > 1
        pieces = [g[i : i + m] for i in [*range(0, window - prefix, prefix), window - prefix]]
        self.deep = np.zeros((2, m), np.uint64)
        for p in pieces:
            self.deep *= FACTORS
            self.deep += p

    def below(self, branching: np.ndarray) -> np.ndarray:
        """Windows, by start, whose prefix occurs again. branching: a flag for each of self.prefixes."""
        keep = np.flatnonzero(self.valid)
        if not len(keep):
            return keep
        leaf = self.leaf[keep]
        head = np.ones(len(leaf), bool)
        head[1:] = leaf[1:] != leaf[:-1]
        flag = branching[np.searchsorted(self.prefixes, leaf[head])]
        return keep[flag[np.cumsum(head) - 1]]

    def nodes(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct nodes of windows, two hashes each, in their order; how often each is there; each window's node."""
        high, low = (mix(x[windows]) for x in self.deep) if len(windows) else np.empty((2, 0), np.uint64)
        order, new = ranked(high, low)
        code = np.empty(len(high), np.int64)
        code[order] = np.cumsum(new) - 1
        first = order[new]
        return np.stack([high[first], low[first]], axis=1), np.bincount(code), code

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """A flag for each word: some of these windows covers it."""
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of hashes, and which of them, in this order, differ from the one before."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    return order, new


def groups(keys: np.ndarray, again: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted keys, of one hash or two, in groups by leading bits: (group, keys, packed marks)."""
    cut = np.searchsorted(keys if keys.ndim == 1 else np.ascontiguousarray(keys[:, 0]), np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *cut.tolist(), len(keys)]
    for g, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            yield g, keys[a:b].tobytes(), np.packbits(again[a:b]).tobytes()


SENT = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), ("keys", pa.binary()), ("again", pa.binary())])


def branching(sent: DataFrame, name: str, hashes: int = 1) -> DataFrame:
    """For each block, whether each key it sent occurs again anywhere: (block_id, found: array of (bucket, n, bits)).

    A key has one 64-bit hash or two.
    """

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, np.uint64).reshape(-1, hashes) for k in table["keys"].to_pylist()]
        keys = np.concatenate(parts)
        if hashes == 1:
            order = np.argsort(keys[:, 0])
            same = np.diff(keys[order, 0]) == 0
        else:
            order, new = ranked(*np.ascontiguousarray(keys.T))
            same = ~new[1:]
        found = np.zeros(len(keys), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        bits, at = [], 0
        for part, again in zip(parts, table["again"].to_pylist()):
            own = np.unpackbits(np.frombuffer(again, np.uint8), count=len(part)).astype(bool)
            bits.append(np.packbits(found[at : at + len(part)] | own).tobytes())
            at += len(part)
        sizes = pa.array([len(p) for p in parts], pa.int64())
        return pa.table({"block_id": table["block_id"], "bucket": table["bucket"], "n": sizes, "bits": pa.array(bits, pa.binary())})

    told = sent.groupBy("bucket").applyInArrow(count, "block_id long, bucket long, n long, bits binary")
    return saved(told.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name)), name)


def flags(found: list[dict] | None) -> np.ndarray:
    """The answer of branching() in the order the keys were sent."""
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(found or [], key=lambda x: x["bucket"])]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def kept_words(texts: pa.Array, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space. keep: a flag for each word of the column."""
    out, n = [], 0
    for _, piece in chunks(texts):
        buf, at = flat(piece)
        start, end, first = spans(buf, at)
        own = keep[n : n + len(start)]
        n += len(start)
        row = np.repeat(np.arange(len(piece)), np.diff(first))[own]
        start, end = start[own], end[own]
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        gap = end[:-1][row[1:] == row[:-1]] if len(row) else end
        inside[gap] = True
        plain = buf.copy()
        plain[gap] = 0x20
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(inside, out=total[1:])
        out.append(pa.Array.from_buffers(pa.large_string(), len(piece), [None, pa.py_buffer(total[at].tobytes()), pa.py_buffer(plain[inside].tobytes())]))
    return (pa.concat_arrays(out) if out else pa.array([], pa.large_string())).cast(pa.string())


def remove_repeats(df: DataFrame, text: str = "text", *, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Add n_words, n_removed and kept_text to every row.

    Words are runs of bytes other than space and 0x09 to 0x0D. Each word covered by ``window`` consecutive words of
    one row that also start anywhere else, in this row or another, is removed; all occurrences go, and windows are
    judged on the input. kept_text joins the other words by one space. Null and empty texts have no words and give
    kept_text ''. Repeated rows count as rows of their own, so a row that is there twice loses every word if it has
    ``window`` words. Other columns stay as they are; columns of the three names above are replaced.
    """
    new = ["n_words", "n_removed", "kept_text"]
    own = [c for c in df.columns if c.lower() not in new]
    df = df.select(*own)
    place = df.columns.index(text)
    blocks = saved(pack(df), "blocks", "uncompressed")
    bits = max(6, (blocks.count() // 2).bit_length())

    def send(block: int, keys: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        rows = list(groups(keys, again, bits))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=SENT)

    @thrifty
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block_id"].to_pylist(), batch["payload"]):
                s = BlockSuffixes(load(payload.as_buffer()).column(place), window, prefix)
                yield send(block, s.prefixes, s.again)

    @thrifty
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, found in zip(batch["block_id"].to_pylist(), batch["payload"], batch["prefixes"].to_pylist()):
                s = BlockSuffixes(load(payload.as_buffer()).column(place), window, prefix)
                keys, count, _ = s.nodes(s.below(flags(found)))
                yield send(block, keys, count > 1)

    ddl = "bucket long, block_id long, keys binary, again binary"
    first = branching(blocks.mapInArrow(prefixes, ddl), "prefixes")
    visit = blocks.join(first.hint("merge"), "block_id", "left")
    deep = branching(visit.mapInArrow(nodes, ddl), "nodes", 2)
    schema = df.select(*own, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema

    @thrifty
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, found, repeats in zip(batch["payload"], batch["prefixes"].to_pylist(), batch["nodes"].to_pylist()):
                rows = load(payload.as_buffer())
                s = BlockSuffixes(rows.column(place), window, prefix)
                windows = s.below(flags(found))
                gone = s.covered(windows[flags(repeats)[s.nodes(windows)[2]]])
                removed = np.concatenate([[0], np.cumsum(gone)])[s.first]
                kept = kept_words(rows.column(place), ~gone)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(s.first)), pa.array(np.diff(removed)), kept], [*own, *new])

    return visit.join(deep.hint("merge"), "block_id", "left").select("payload", "prefixes", "nodes").mapInArrow(remove, schema)
