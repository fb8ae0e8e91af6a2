"""Benchmark decontamination by latent semantic retrieval.

Passages of documents (24 words, every 12) and of benchmark items (48 words, every 24) are TF-IDF vectors over hashed
words. A randomised singular value decomposition over the passages of all documents and items, summed over Spark tasks,
gives a latent space of ``RANK`` dimensions; items are put into it, and a passage is a candidate for an item when the
cosine of its vector with the item's latent vector is high enough. A candidate is a leak if the longest common
subsequence of item and surroundings covers most of the item, or, for looser paraphrases, a good part of it and of its
answer, the item's last words.

The cosine proves nothing for items of common words, so an exact search stands beside it: a text that has that part of
an item has some of the item's rarest words, and where its words could reach the part, they are compared as well. So no
text is missed that the comparison would call a leak; verbatim copies are among them.

Words are hashed once, into blocks of rows; document frequencies, the decomposition and the search go through every
word of every document from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blocks import load, loosened, pack, saved, squeezed, thrifty
from pagewright.llm.words import MARKS, texts_words

SEGMENT = 12  # words; a passage is two segments
HASH_BITS = 32  # of a word's hash
BUCKETS, COLUMNS = 1 << 18, 1 << 16  # of words by the leading bits of their hashes: for idf, and for the vectors
ITEM_PASSAGE = 48
TOGETHER = 256  # item passages that share a latent space
RANK = 32
COSINE = 0.35
MOST, PART, ANSWER = 0.8, 0.6, 0.5
BLOCK = 4 << 20
PIECE = 1 << 15  # words looked at together
FAN = 1000  # tasks whose sums are added up in one place
LEAK = "item_id long, cosine double, lcs_share double, answer_share double, first_word long, last_word long"


class Passage(NamedTuple):
    item_id: int
    words: tuple[int, ...]
    answer: int  # how many of the last words are the answer


class Anchors(NamedTuple):
    """The words of some item passages. The rarest ones are anchors: a text that has PART of a passage has at least
    ``least`` of its anchors."""

    words: np.ndarray  # sorted
    times: np.ndarray  # words x passages: how often the passage has the word
    start: np.ndarray  # of each word's passages of which it is an anchor, and their end
    passage: np.ndarray
    least: np.ndarray  # by passage
    need: np.ndarray  # words in order that make a leak
    size: np.ndarray


class Space(NamedTuple):
    """A latent space and the item passages in it."""

    basis: np.ndarray  # COLUMNS x rank, orthonormal
    passages: list[Passage]
    items: np.ndarray  # rank x passages: unit latent vectors


def needed_words(p: Passage) -> int:
    """The fewest words in order that can be a leak."""
    return next(k for k in range(1, len(p.words) + 1) if k / len(p.words) >= PART)


def anchors(passages: list[Passage], idf: np.ndarray) -> Anchors:
    words = np.unique(np.array([w for p in passages for w in p.words], np.int64))
    times = np.zeros((len(words) + 1, len(passages)), np.int16)
    need = np.array([needed_words(p) for p in passages], np.int64)
    least, pairs = np.maximum(1, need // 2), set()
    for i, p in enumerate(passages):
        np.add.at(times[:, i], np.searchsorted(words, p.words), 1)
        rare = sorted(p.words, key=lambda w: (-float(idf[bucket(w)]), w))[: len(p.words) - need[i] + least[i]]
        pairs |= {(int(np.searchsorted(words, w)), i) for w in rare}
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return Anchors(words, times, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1], least, need, np.array([len(p.words) for p in passages], np.int64))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... with size[0] values, then those of start[1], and so on."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def possible(a: Anchors, code: np.ndarray, first: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, passage) pairs whose surroundings have enough anchors: all that have PART of the passage.

    code: of each word its number in a.words, or their number; begin: the first segment of each text.
    """
    at = np.flatnonzero(code < len(a.words))
    n = np.diff(a.start)[code[at]]
    passage, place = a.passage[ranges(a.start[code[at]], n)], np.repeat(at, n)
    order = np.argsort(passage * len(code) + place)
    passage, place = passage[order], place[order]
    last = np.arange(len(place)) + a.least[passage] - 1
    ok = np.flatnonzero(last < len(place))
    ok = ok[passage[last[ok]] == passage[ok]]
    x, y, passage = place[ok], place[last[ok]], passage[ok]
    text, size = np.searchsorted(first, x, "right") - 1, a.size[passage]
    end = begin[text + 1] - begin[text]
    lo = np.maximum((y - first[text] - 2 * SEGMENT - size) // SEGMENT + 1, 0)
    hi = np.minimum((x - first[text] + size) // SEGMENT + 1, end)
    own = (lo < hi) & (y < first[text + 1])
    lo, hi, text, passage = lo[own], hi[own], text[own], passage[own]
    pair = np.unique(ranges(begin[text] + lo, hi - lo) * len(a.size) + np.repeat(passage, hi - lo))
    return pair // len(a.size), pair % len(a.size)


def with_enough_words(a: Anchors, code: np.ndarray, lo: np.ndarray, hi: np.ndarray, passage: np.ndarray, piece: int = 2048) -> np.ndarray:
    """Which windows of words [lo, hi) have as many of the passage's words, in any order, as a leak needs."""
    keep = np.zeros(len(lo), bool)
    for i in range(0, len(lo), piece):
        start, size, p = lo[i : i + piece], hi[i : i + piece] - lo[i : i + piece], passage[i : i + piece]
        wide = np.arange(int(size.max()))
        table = np.where(wide < size[:, None], code[np.minimum(start[:, None] + wide, len(code) - 1)], len(a.words)).astype(np.int32)
        table.sort(axis=1)
        new = np.ones(table.shape, bool)
        new[:, 1:] = table[:, 1:] != table[:, :-1]
        earlier = wide - np.maximum.accumulate(np.where(new, wide, 0), axis=1)  # equal words before it in the window
        keep[i : i + piece] = (a.times[table, p[:, None]] > earlier).sum(axis=1) >= a.need[p]
    return keep


def bucket(h):
    """A word's bucket, of hashes as they are kept: HASH_BITS bits."""
    return h >> (HASH_BITS - BUCKETS.bit_length() + 1)


def column(h):
    return h >> (HASH_BITS - COLUMNS.bit_length() + 1)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and each text's first word."""
    h, first = texts_words(texts, True, MARKS)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64), first


def item_passages(items: DataFrame, item_id: str, text: str) -> list[Passage]:
    """Items as passages of 48 words, every 24; shorter items and ends as they are. Items without words give none."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null").toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
    h, first = hashed(rows["t"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    out = {}
    for i, lo, hi in zip(rows["i"].to_pylist(), first[:-1].tolist(), first[1:].tolist()):
        w = tuple(h[lo:hi].tolist())
        for a in range(0, max(1, len(w) - ITEM_PASSAGE // 2), ITEM_PASSAGE // 2):
            if c := w[a : a + ITEM_PASSAGE]:
                out[i, c] = Passage(i, c, max(1, len(c) // 4))
    return list(out.values())


def hashed_rows(docs: DataFrame, text: str) -> DataFrame:
    """Blocks of the rows of docs with the hashes of their words."""
    place = docs.columns.index(text)

    def words(rows: pa.RecordBatch) -> list[bytes]:
        return [squeezed(x) for x in hashed(rows.column(place))]

    return saved(pack(docs, BLOCK, ("words", "first"), words), "hashed", "uncompressed")


def pieces(words: bytes, first: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A block's words, some texts at a time: (first text, hashes, each text's first word)."""
    h, at = loosened(words).astype(np.int64), loosened(first).astype(np.int64)
    row = 0
    while row < len(at) - 1:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        yield row, h[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def summed(parts: DataFrame, rows: int) -> np.ndarray:
    """The sum of equally shaped float32 matrices that tasks gave in slices: (fan, slice, data) rows, added up in two steps."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["data"])
        return pa.table({"fan": pa.array([0], pa.int32()), "slice": table["slice"].slice(0, 1), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    some = parts.groupBy("fan", "slice").applyInArrow(add, "fan int, slice int, data binary")
    got = some.groupBy("slice").applyInArrow(add, "fan int, slice int, data binary").toArrow().sort_by("slice")
    flat_sum = [np.frombuffer(x, np.float32) for x in got["data"].to_pylist()]
    return np.concatenate(flat_sum).reshape(rows, -1) if flat_sum else np.zeros((rows, 0), np.float32)


def slices(matrix: np.ndarray, n: int = 32) -> pa.RecordBatch:
    parts = np.array_split(np.ascontiguousarray(matrix, np.float32), min(n, len(matrix)))
    fan = np.full(len(parts), TaskContext.get().partitionId() // FAN, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(fan), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["fan", "slice", "data"])


def inverse_frequencies(blocks: DataFrame) -> np.ndarray:
    """idf of each word bucket, from the number of documents that have it."""

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for words, first in zip(batch["words"].to_pylist(), batch["first"].to_pylist()):
                for _, h, at in pieces(words, first):
                    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                    found[:BUCKETS] += np.bincount(np.unique(row * BUCKETS + bucket(h)) % BUCKETS, minlength=BUCKETS)
                    found[BUCKETS] += len(at) - 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["bucket", "n"])

    told = blocks.select("words", "first").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS + 1)
    total[told["bucket"].to_numpy()] = told["n"].to_numpy()
    return np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS])).astype(np.float32) + np.float32(0.1)


class Segments:
    """Texts cut into segments of 12 words; a passage is a segment and the next one of its text."""

    def __init__(self, h: np.ndarray, first: np.ndarray, idf: np.ndarray):
        n = np.diff(first)
        self.begin = np.concatenate([[0], np.cumsum((n + SEGMENT - 1) // SEGMENT)])
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        self.segment = np.repeat(self.begin[:-1], n) + place // SEGMENT
        self.column, self.weight = column(h), idf[bucket(h)]
        self.table = np.full((self.begin[-1], SEGMENT), COLUMNS)  # of each segment's words; a row of zeros where it has no more
        self.heavy = np.zeros((self.begin[-1], 1, SEGMENT), np.float32)
        slot = place % SEGMENT
        self.table[self.segment, slot], self.heavy[self.segment, 0, slot] = self.column, self.weight
        last = np.zeros(self.begin[-1], bool)
        last[self.begin[1:][n > 0] - 1] = True
        self.follows = ~last[:-1]  # the next segment is the same text's
        self.norm = np.sqrt(np.maximum(self.passages((self.heavy * self.heavy).sum(axis=2)), 1e-9))

    def passages(self, x: np.ndarray) -> np.ndarray:
        """Sums of segments' rows over each passage."""
        out = x.copy()
        out[:-1] += x[1:] * self.follows[:, None]
        return out

    def back(self, z: np.ndarray) -> np.ndarray:
        """For each segment the sum of the passages that it is part of."""
        out = z.copy()
        out[1:] += z[:-1] * self.follows[:, None]
        return out

    def project(self, basis: np.ndarray) -> np.ndarray:
        """Unit TF-IDF passages times a matrix, that has a last row of zeros."""
        out = np.empty((len(self.table), basis.shape[1]), np.float32)
        for i in range(0, len(out), PIECE // SEGMENT):
            part = slice(i, i + PIECE // SEGMENT)
            out[part] = np.matmul(self.heavy[part], basis[self.table[part]])[:, 0]
        return self.passages(out) / self.norm


def latent_space(blocks: DataFrame, passages: list[Passage], idf: np.ndarray, rank: int = RANK, seed: int = 3) -> Space:
    """Fit the space of some item passages: a randomised SVD of TF-IDF passages with one power iteration.

    Rows are the passages of all documents and the item passages, which together weigh as much as those; columns are all
    words, hashed. The rank is at most half the number of item passages, so that items share dimensions. Tasks sum
    A'(A R) for a random R; its orthonormal basis Q spans the leading right singular space; they then sum (A Q)'(A Q),
    whose eigenvectors turn Q into singular vectors.
    """
    own = np.zeros((len(passages), COLUMNS), np.float32)
    for i, p in enumerate(passages):
        w = np.array(p.words)
        np.add.at(own[i], column(w), idf[bucket(w)])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    rank = min(rank, max(8, len(passages) // 2))
    start = np.random.default_rng(seed).normal(size=(COLUMNS, rank)).astype(np.float32)

    def product(basis: np.ndarray, inner: bool) -> np.ndarray:
        """A'(A basis), or with inner (A basis)'(A basis), over all documents; a first row has the number of passages."""
        held = blocks.sparkSession.sparkContext.broadcast((np.vstack([basis, np.zeros((1, rank), np.float32)]), idf))

        @thrifty
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, idf = held.value
            total = np.zeros((1 + (rank if inner else COLUMNS), rank), np.float32)
            for batch in batches:
                for words, first in zip(batch["words"].to_pylist(), batch["first"].to_pylist()):
                    for _, h, at in pieces(words, first):
                        if not len(h):
                            continue
                        s = Segments(h, at, idf)
                        z = s.project(basis)
                        total[0] += len(z)
                        if inner:
                            total[1:] += z.T @ z
                        else:
                            z = s.back(z / s.norm)
                            order = np.argsort(s.column.astype(np.uint16), kind="stable")  # 16 bits are sorted by digits
                            ranked = s.column[order]
                            head = np.flatnonzero(np.diff(ranked, prepend=-1))
                            total[1 + ranked[head]] += np.add.reduceat(z[s.segment[order]] * s.weight[order, None], head, axis=0)
            yield slices(total)

        theirs = summed(blocks.select("words", "first").mapInArrow(multiply, "fan int, slice int, data binary"), 1 + (rank if inner else COLUMNS))
        a = own @ basis
        mine = a.T @ a if inner else own.T @ a
        return mine + theirs[1:] * (len(passages) / theirs[0, 0]) if theirs.size and theirs[0, 0] else mine

    q, _ = np.linalg.qr(product(start, False))
    _, turn = np.linalg.eigh(product(q.astype(np.float32), True))
    basis = (q @ turn[:, ::-1]).astype(np.float32)
    latent = basis.T @ own.T
    return Space(np.vstack([basis, np.zeros((1, rank), np.float32)]), passages, latent / np.maximum(np.linalg.norm(latent, axis=0), 1e-9))


def common_length(a: tuple[int, ...] | list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    place: dict[int, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & place.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def verdict(passage: Passage, around: list[int]) -> tuple[float, float] | None:
    """Shares of the passage and of its answer that the surroundings have in order, if that makes a leak."""
    share = common_length(passage.words, around) / len(passage.words)
    if share < PART:
        return None
    answer = common_length(passage.words[-passage.answer :], around) / passage.answer
    return (share, answer) if share >= MOST or answer >= ANSWER else None


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", *, item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE) -> DataFrame:
    """Add an array of the benchmark items that each whole text leaks, ascending by item_id; empty if none.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. An item's entry is its best passage: the
    highest lcs_share, then answer_share, then cosine, then the first place; first_word and last_word are the words
    of the text that were compared. Null and empty texts leak nothing; items without id or words are never leaked;
    repeated items count once, repeated rows get equal results. An empty table gives no rows. Other columns stay, a
    column called like ``out`` is replaced.

    The benchmark is the query set: it is held by the driver and broadcast, in blocks of ``TOGETHER`` passages with a
    space each, so the tool is for benchmarks, not for matching corpora.
    """
    own = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*own)
    blocks = hashed_rows(docs, text)
    passages = item_passages(items, item_id, item_text)
    idf = inverse_frequencies(blocks)
    spaces = [latent_space(blocks, passages[i : i + TOGETHER], idf) for i in range(0, len(passages), TOGETHER)]
    held = docs.sparkSession.sparkContext.broadcast((idf, spaces, [anchors(s.passages, idf) for s in spaces]))
    names = [f.split()[0] for f in LEAK.split(", ")]
    shape = pa.list_(pa.struct([(n, pa.int64() if k == "long" else pa.float64()) for n, k in (f.split() for f in LEAK.split(", "))]))

    def leaks(words: bytes, first: bytes) -> pa.Array:
        """Of a block's texts."""
        idf, spaces, rare = held.value
        found: list[dict[int, tuple]] = [{} for _ in range(len(loosened(first)) - 1)]
        for row, h, at in pieces(words, first):
            if not len(h):
                continue
            s = Segments(h, at, idf)
            for space, exact in zip(spaces, rare):
                near = s.project(space.basis) @ space.items
                code = np.searchsorted(exact.words, h)
                code[exact.words[np.minimum(code, len(exact.words) - 1)] != h] = len(exact.words)
                pairs = [np.nonzero(near >= cosine), possible(exact, code, at, s.begin)]
                pair = np.unique(np.concatenate([seg * near.shape[1] + p for seg, p in pairs]))
                seg, p = pair // near.shape[1], pair % near.shape[1]
                doc = np.searchsorted(s.begin, seg, "right") - 1
                place = at[doc] + (seg - s.begin[doc]) * SEGMENT
                lo = np.maximum(at[doc], place - exact.size[p])
                hi = np.minimum(at[doc + 1], place + 2 * SEGMENT + exact.size[p])
                for k in np.flatnonzero(with_enough_words(exact, code, lo, hi, p)).tolist():
                    passage, own = space.passages[p[k]], int(doc[k])
                    if shares := verdict(passage, h[lo[k] : hi[k]].tolist()):
                        entry = (*shares, float(near[seg[k], p[k]]), int(at[own] - lo[k]), int(hi[k] - 1 - at[own]))
                        old = found[row + own].get(passage.item_id)
                        if old is None or entry > old:
                            found[row + own][passage.item_id] = entry
        return pa.array([[dict(zip(names, (i, e[2], e[0], e[1], -e[3], e[4]))) for i, e in sorted(f.items())] for f in found], shape)

    @thrifty
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, words, first in zip(batch["payload"], batch["words"].to_pylist(), batch["first"].to_pylist()):
                yield pa.RecordBatch.from_arrays([*load(payload.as_buffer()).columns, leaks(words, first)], [*own, out])

    ddl = "array<struct<" + ", ".join(f.replace(" ", ": ") for f in LEAK.split(", ")) + ">>"
    return blocks.select("payload", "words", "first").mapInArrow(search, docs.withColumn(out, F.lit(None).cast(ddl)).schema)
