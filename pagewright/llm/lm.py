"""Language-model scores from a probabilistic suffix tree over words, beside a unigram base score.

A text is its words (A-Z lower-cased) and one end. States are contexts of the last 1 to ``REACH`` words, the start of
the text counting as one; they cross words and are counted over every word of every training text. The root is the base
distribution, in which all words that training doesn't have share one class. A longer context has its own next-word
distribution, smoothed with that of the longest kept context that is shorter:

    p(x | context) = (n(x) + (kinds + rare) * p(x | shorter)) / (total + kinds)

n(x) counts x after the context, kinds counts such words, and rare is the weight of words that training has only once
after the context one word shorter; these are left to the shorter context, so that a word seen once in training scores
like one seen nowhere. A context is kept if it occurs at least twice in training, if it doesn't always stand behind the
same further word (else it is no node of its own), and if its distribution diverges: the training words after it are by
``DIVERGENCE`` nats likelier under its own counts than under the shorter context. Each word is scored in the state of
the longest kept suffix of the words before it.

The tree grows level by level and is never in one place. A block sends its distinct contexts, with sums over its
training words, to groups of context hashes; a group adds up all blocks, tests each context and answers each block.
A context with more than ``HOT`` occurrences is spread over groups by its next words. A context's number of
occurrences is the count of its last word one level up, so a block knows without asking which contexts can matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.blocks import load, loosened, pack, saved, squeezed
from pagewright.llm.words import chunks, flat, mix, spans, word_hashes

DIVERGENCE = 4.0
BASE_EPSILON = 0.5
REACH = 3  # words of the longest context
BLOCK = 4 << 20  # bytes of a block: a walk holds several times as much
HOT = 1 << 22
HOT_SHARE = 1 << 20  # no context under this part of all training tokens is spread, so a level has at most twice as many parts
HEAD, TAIL = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # stand for the start and the end of a text
STEP = np.uint64(0x9E3779B97F4A7C15)
ROUNDS = (1, 2, 1)  # by level, the last for all further ones: in so many parts by groups, so that less is on disk at once
KEY_BYTES, NEXT_BYTES = 6, 5  # that tell apart the contexts of one group, and the words after one context

WORDS = ("symbols", "code", "first", "train")
RESULTS = ["n_tokens", "n_known", "base_score", "score"]
ANSWER = "block_id long, bucket long, level int, spare binary, kinds binary, n binary"
ANSWER_WIRE = pa.schema([("block_id", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("spare", pa.binary()), ("kinds", pa.binary()), ("n", pa.binary())])
SENT = ["keys", "hot", "asked", "past", "rare", "next", "counts"]
SENT_WIRE = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), *[(c, pa.binary()) for c in SENT]])


class Model(NamedTuple):
    """What every block needs to know."""

    texts: int  # in training
    tokens: int
    distinct: int
    divergence: float
    hot: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + BASE_EPSILON) - np.log10(self.tokens + BASE_EPSILON * (self.distinct + 1))


class Sums(NamedTuple):
    """Of contexts, over their training words. ``n`` are counts of next words that the shorter context has twice."""

    logs: np.ndarray  # sum of n * ln n
    strong: np.ndarray  # sum of n
    kinds: np.ndarray  # how many n are above 0
    past: np.ndarray  # their ln probability in the shorter context, summed over occurrences
    rare: np.ndarray  # occurrences of other words

    def gain(self) -> np.ndarray:
        """By how many nats training is at least likelier with the context's own distribution."""
        size = np.maximum(self.strong + self.rare + self.kinds, 1)
        spare = np.maximum(self.rare + self.kinds, 1)
        return self.logs - self.strong * np.log(size) - self.past + self.rare * (np.log(spare) - np.log(size))


def widened(data: bytes, size: int) -> np.ndarray:
    """Hashes of which the lowest ``size`` bytes were sent."""
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view(np.uint64)[:, 0]


def numbers(data: bytes) -> np.ndarray:
    return loosened(data).astype(np.int64)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the number of each value among them."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    code = np.empty(len(key), np.int64)
    code[order] = np.cumsum(new) - 1
    return ranked[new], code


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([*parts, np.empty(0, kind)])


def group_edges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Sorted keys in groups by their leading bits: (group, from, to)."""
    edges = [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)]
    return [(g, a, b) for g, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


class Asked(NamedTuple):
    """A level of a block. A pair is a context and a next word; a unit is a context, or a part of a hot one."""

    at: np.ndarray  # places whose context occurs twice
    code: np.ndarray  # their pairs
    owner: np.ndarray  # each pair's context, as a number of the level before
    symbol: np.ndarray
    where: np.ndarray  # one of its places
    row: np.ndarray  # its context, as a row of the next ones
    total: np.ndarray  # of contexts: occurrences in training
    own: np.ndarray  # of contexts: a node of the tree
    keys: np.ndarray  # of contexts
    unit: np.ndarray  # of pairs: rank among units by key, -1 if not asked
    units: np.ndarray  # keys of units, ascending
    unit_row: np.ndarray
    strong: np.ndarray  # pairs to ask for, in the order of units


class Walk:
    """The words of a block as places of one sequence, each text between a start and an end, and their log10 probability
    in the longest kept context so far."""

    def __init__(self, words: dict, counts: np.ndarray, model: Model):
        """words: a row of WORDS; counts: of its words in training, in the order of hashes."""
        symbols, code, first = np.frombuffer(words["symbols"], np.uint64), numbers(words["code"]), numbers(words["first"])
        n, kinds = np.diff(first), len(symbols)
        self.model, self.counts = model, np.zeros(kinds, np.int64)
        self.counts[np.argsort(symbols)] = counts
        self.first = first + 2 * np.arange(len(first))
        self.symbols = np.concatenate([symbols, [TAIL, HEAD]])
        self.code = np.full(self.first[-1], kinds + 1, np.int64)
        self.code[self.first[1:] - 1] = kinds
        self.code[np.arange(len(code)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = code
        self.place = np.arange(len(self.code)) - np.repeat(self.first[:-1], n + 2)
        self.train = np.repeat(loosened(words["train"]) > 0, n + 2)
        every = np.append(self.counts, [model.texts, model.texts])
        self.n = every[self.code]  # of the place's pair in training, or of its word alone
        self.score = model.base(every)[self.code]
        self.before = np.full(len(self.code), -1)  # occurrences of the context one word shorter
        self.ids, self.hashes = self.code, self.symbols  # of the sequences of ``level`` words that end at each place

    def ask(self, level: int, bits: int = 0, part: int = 0, parts: int = 1) -> Asked:
        """With ``parts`` only the contexts whose group is in that part, and the hot ones, whose words go to groups of all parts."""
        total = np.zeros(len(self.n), np.int64)
        total[1:] = self.n[:-1]
        at = np.flatnonzero((total >= 2) & (self.place >= level))
        if parts > 1:
            mine = (self.hashes >> np.uint64(64 - bits)) % np.uint64(parts) == part
            at = at[mine[self.ids[at - 1]] | (total[at] > self.model.hot)]
        pair, code = grouped(self.ids[at - 1] * len(self.symbols) + self.code[at])
        owner, symbol = pair // len(self.symbols), pair % len(self.symbols)
        where = np.empty(len(pair), np.int64)
        where[code] = at
        head = np.ones(len(pair), bool)
        head[1:] = owner[1:] != owner[:-1]
        row = np.cumsum(head) - 1
        total = total[where[head]]
        own = total != self.before[where[head]]
        keys = self.hashes[owner[head]]
        parts = -(-total // self.model.hot)
        if hot := bool((parts > 1).any()):
            salt = (mix(self.symbols[symbol]) % parts[row].astype(np.uint64)).astype(np.int64)
            name, unit = grouped(row * (int(parts.max()) + 1) + salt)
            unit_row, salt = name // (int(parts.max()) + 1), name % (int(parts.max()) + 1)
            units = np.where(parts[unit_row] > 1, self.part_keys(keys[unit_row], salt), keys[unit_row])
        else:
            units, unit_row, unit = keys, np.arange(len(keys)), row
        order = np.argsort(units)
        order = order[own[unit_row[order]]]
        rank = np.full(len(units), -1, np.int64)
        rank[order] = np.arange(len(order))
        unit = rank[unit]
        strong = np.flatnonzero((unit >= 0) & (self.n[where] >= 2))
        strong = strong[np.argsort(unit[strong], kind="stable")]
        return Asked(at, code, owner, symbol, where, row, total, own, keys, unit, units[order], unit_row[order], strong)

    @staticmethod
    def part_keys(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mix(keys + (part + 1).astype(np.uint64) * STEP)

    def messages(self, level: int, block: int, bits: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        """To groups whose number modulo ``parts`` is ``part``."""
        a = self.ask(level, bits, part, parts)
        learn = self.train[a.at]
        unit = a.unit[a.code]
        seen_twice = self.n[a.at] >= 2
        own = learn & (unit >= 0)
        counts = np.bincount(a.code, learn, minlength=len(a.owner))[a.strong].astype(np.int32)
        past = np.bincount(unit[own & seen_twice], self.score[a.at[own & seen_twice]], minlength=len(a.units)) * np.log(10)
        past = past.astype(np.float32)
        rare = np.bincount(unit[own & ~seen_twice], minlength=len(a.units)).astype(np.int32)
        asked = np.bincount(a.unit[a.strong], minlength=len(a.units)).astype(np.int32)
        short = np.ascontiguousarray(self.symbols[a.symbol[a.strong]].view(np.uint8).reshape(-1, 8)[:, :NEXT_BYTES])
        del learn, unit, seen_twice, own
        hot = (a.total[a.unit_row] > self.model.hot).astype(np.uint8)
        end = np.concatenate([[0], np.cumsum(asked)])
        for g, i, j in group_edges(a.units, bits):
            if g % parts != part:
                continue
            x, y = int(end[i]), int(end[j])
            columns = [a.units[i:j].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes(), *map(squeezed, (hot[i:j], asked[i:j], past[i:j], rare[i:j])), short[x:y].tobytes(), squeezed(counts[x:y])]
            yield pa.RecordBatch.from_pylist([{"bucket": g, "block_id": block} | dict(zip(SENT, columns))], SENT_WIRE)

    def go_down(self, level: int, answers: list[dict], hot: tuple[np.ndarray, Sums]) -> None:
        """Take the answers of a level's groups, in the order of groups."""
        a = self.ask(level)
        held = [joined([numbers(x[c]) for x in answers], np.int64) for c in ("spare", "kinds", "n")]
        spare, kinds = np.zeros(len(a.total), np.int64), np.zeros(len(a.total), np.int64)
        spare[a.unit_row], kinds[a.unit_row] = held[0], held[1]
        for r in np.flatnonzero(a.own & (a.total > self.model.hot)):
            spare[r], kinds[r] = self.hot_state(a.keys[r], int(a.total[r]), hot)
        pairs = np.minimum(self.n[a.where], 1)  # words that the shorter context has once or not at all
        pairs = np.where(a.own[a.row], pairs, self.n[a.where])
        pairs[a.strong] = held[2]
        kept = (spare > 0)[a.row][a.code]
        at, code = a.at[kept], a.code[kept]
        row = a.row[code]
        n = np.where(self.n[at] >= 2, pairs[code], 0)
        self.score[at] = np.log10(n + spare[row] * 10.0 ** self.score[at]) - np.log10(a.total[row] + kinds[row])
        self.before = np.zeros(len(self.n), np.int64)
        self.before[1:] = self.n[:-1]
        self.n = np.zeros(len(self.n), np.int64)
        self.n[a.at] = pairs[a.code]
        self.ids = np.full(len(self.n), -1, np.int64)
        self.ids[a.at] = a.code
        self.hashes = mix(self.hashes[a.owner] * STEP + self.symbols[a.symbol])

    def hot_state(self, key: np.uint64, total: int, hot: tuple[np.ndarray, Sums]) -> tuple[int, int]:
        """Spare weight and kinds of a context whose words are spread over groups; 0 if it isn't kept."""
        parts = -(-total // self.model.hot)
        names = self.part_keys(np.full(parts, key), np.arange(parts)) & np.uint64((1 << 8 * KEY_BYTES) - 1)
        k = np.minimum(np.searchsorted(hot[0], names), max(len(hot[0]) - 1, 0))
        k = k[hot[0][k] == names]
        s = Sums(*[x[k].sum(keepdims=True) for x in hot[1]])
        return (int(s.kinds[0] + s.rare[0]), int(s.kinds[0])) if s.gain()[0] >= self.model.divergence else (0, 0)


def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word hashes of a block, frequent ones first, the number of each word among them, and each text's first
    word."""
    hashes, first, n = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, piece in chunks(texts):
        buf, at = flat(piece)
        s, e, f = spans(buf, at)
        hashes.append(word_hashes(buf, s, e, lower=True))
        first.append(f[1:] + n)
        n += len(s)
    keys, code = grouped(np.concatenate(hashes))
    order = np.argsort(-np.bincount(code, minlength=len(keys)), kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return keys[order], rank[code], np.concatenate(first)


def split_words(rows: DataFrame, text: int, train: int, left_out: tuple[int, ...]) -> DataFrame:
    """Blocks of rows with their words (WORDS) and the number of training texts: later steps start from these and not
    from texts. The payload has the columns that are not at ``left_out``."""

    def split(batch: pa.RecordBatch) -> list[bytes]:
        symbols, code, first = block_words(batch.column(text))
        learn = batch.column(train).to_numpy(zero_copy_only=False).astype(np.uint8)
        return [symbols.tobytes(), squeezed(code), squeezed(first), squeezed(learn), int(learn.sum()).to_bytes(8, "big")]

    return saved(pack(rows, BLOCK, (*WORDS, "texts"), split, left_out), "words", "uncompressed")


def count_words(words: DataFrame, bits: int) -> DataFrame:
    """Training counts of words: each block's, in the order of hashes, by groups of hashes; and for each group a row of
    block -1 whose n are its numbers of distinct words and of words in training."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch.to_pylist():
                symbols, code, first, train = np.frombuffer(w["symbols"], np.uint64), numbers(w["code"]), numbers(w["first"]), loosened(w["train"]) > 0
                order = np.argsort(symbols)
                n = np.bincount(code[np.repeat(train, np.diff(first))], minlength=len(symbols))[order]
                symbols = symbols[order]
                for g, a, b in group_edges(symbols, bits):
                    yield pa.RecordBatch.from_pylist([{"bucket": g, "block_id": w["block_id"], "keys": symbols[a:b].tobytes(), "counts": squeezed(n[a:b])}], wire)

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        keys, code = grouped(np.concatenate(parts))
        total = np.bincount(code, np.concatenate([numbers(x) for x in table["counts"].to_pylist()]), minlength=len(keys)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        back = [squeezed(total[code[b - len(p) : b]]) for p, b in zip(parts, ends.tolist())]
        rows = [*zip(table["block_id"].to_pylist(), back), (-1, squeezed(np.array([np.count_nonzero(total), total.sum()])))]
        return pa.Table.from_pylist([{"block_id": k, "bucket": table["bucket"][0].as_py(), "level": 0, "spare": b"", "kinds": b"", "n": n} for k, n in rows], ANSWER_WIRE)

    wire = pa.schema([("bucket", pa.int64()), ("block_id", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    sent = words.select("block_id", *WORDS).mapInArrow(ask, "bucket long, block_id long, keys binary, counts binary")
    return saved(sent.groupBy("bucket").applyInArrow(count, ANSWER), "word-counts")


def count_level(asking: DataFrame, walk, level: int, part: int, parts: int, bits: int, divergence: float) -> DataFrame:
    """Count and test the contexts of ``level`` words in one part of the groups: answers by block and group; rows of block -1 have sums of hot parts.

    ``walk`` gives the Walk of a row of ``asking`` down to the level before. spare is 0 for contexts that aren't kept.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from walk(row).messages(level, row["block_id"], bits, part, parts)

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id")
        plain = {"keys": lambda x: widened(x, KEY_BYTES), "next": lambda x: widened(x, NEXT_BYTES)}
        parts = [[plain.get(c, loosened)(x) for x in table[c].to_pylist()] for c in SENT]
        sizes, asks = [len(k) for k in parts[0]], [int(x.sum()) for x in parts[2]]
        keys, hot, asked, past, rare, short, counts = (np.concatenate(p) for p in parts)
        own, code = grouped(keys)
        pair, place = grouped(np.repeat(code, asked).astype(np.uint64) << np.uint64(8 * NEXT_BYTES) | short)
        n = np.bincount(place, counts, minlength=len(pair)).astype(np.int64)
        owner = (pair >> np.uint64(8 * NEXT_BYTES)).astype(np.int64)
        total = lambda at, x: np.bincount(at, x, minlength=len(own))
        s = Sums(total(owner, n * np.log(np.maximum(n, 1))), total(owner, n), total(owner, n > 0), total(code, past), total(code, rare))
        keep = s.gain() >= divergence
        kinds, spare = np.where(keep, s.kinds, 0).astype(np.int64), np.where(keep, s.kinds + s.rare, 0).astype(np.int64)
        head = {"bucket": table["bucket"][0].as_py(), "level": level}
        rows, i, j = [], 0, 0
        for block, k, p in zip(table["block_id"].to_pylist(), sizes, asks):
            mine = code[i : i + k]
            rows.append(head | {"block_id": block, "spare": squeezed(spare[mine]), "kinds": squeezed(kinds[mine]), "n": squeezed(n[place[j : j + p]])})
            i, j = i + k, j + p
        if hot.any():
            held = np.unique(code[hot > 0])
            rows.append(head | {"block_id": -1, "spare": own[held].tobytes(), "kinds": b"", "n": np.stack([x[held] for x in s]).astype(np.float64).tobytes()})
        return pa.Table.from_pylist(rows, ANSWER_WIRE)

    sent = asking.mapInArrow(ask, "bucket long, block_id long, " + ", ".join(f"{c} binary" for c in SENT))
    return saved(sent.groupBy("bucket").applyInArrow(count, ANSWER), "contexts")


def hot_sums(told: list[DataFrame]) -> tuple[np.ndarray, Sums]:
    """The parts of hot contexts of a level, by key. There are at most 2 * HOT_SHARE of them, whatever the input."""
    rows = pa.concat_tables([t.where("block_id = -1").select("spare", "n").toArrow() for t in told])
    keys = joined([np.frombuffer(x, np.uint64) for x in rows["spare"].to_pylist()], np.uint64)
    sums = [np.frombuffer(x, np.float64).reshape(len(Sums._fields), -1) for x in rows["n"].to_pylist()]
    table = np.concatenate([*sums, np.empty((len(Sums._fields), 0))], axis=1)
    order = np.argsort(keys)
    return keys[order], Sums(*table[:, order])


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Files of a shuffle go as soon as the table made from it is saved."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def score_texts(df: DataFrame, train: Column, text: str = "text", *, divergence: float = DIVERGENCE, reach: int = REACH, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to every row.

    train says which rows the model learns from (null: no). Tokens are the words, A-Z lower-cased, and one end; null
    texts are empty, so they have the end alone. base_score is the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V +
    1))) with c, N and V counted in training tokens; score is the model's log10 probability of the tokens.
    Without training rows N and V are 0, and both scores are 0. Repeated rows are rows of their own. An empty table
    gives no rows. Other columns stay; columns of the five names are replaced. Without
    keep_text the text column goes, and no texts are written in between.

    Words are told apart by 64-bit hashes, contexts by their group and 48 bits, the words after one context by 40 bits.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    own = [c for c in df.columns if c.lower() not in new]
    kept = [c for c in own if keep_text or c != text]
    rows = df.select(*own, F.coalesce(train, F.lit(False)).alias("__train"))
    schema = df.select(*kept, *[F.lit(0).cast("long").alias(c) for c in new[:3]], *[F.lit(0.0).alias(c) for c in new[3:]]).schema
    place = own.index(text)
    with brief_shuffles(df.sparkSession):
        words = split_words(rows, place, len(own), () if keep_text else (place,))
        return _scored(words, schema, [*kept, *new], divergence, reach, hot)


def _scored(words: DataFrame, schema, names: list[str], divergence: float, reach: int, hot: int) -> DataFrame:
    n_blocks, texts = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.conv(F.hex("texts"), 16, 10).cast("long")), F.lit(0))).first()
    bits = max(6, (n_blocks // 2).bit_length())
    told = [count_words(words, bits)]
    groups = [numbers(x) for x in told[0].where("block_id = -1").select("n").toArrow()["n"].to_pylist()]
    kinds, seen = np.sum([np.zeros(2, np.int64), *groups], axis=0).tolist()
    model = Model(texts, seen + texts, kinds + (texts > 0), divergence, max(hot, (seen + texts) // HOT_SHARE))
    context, spread = words.sparkSession.sparkContext, []

    def walk(row: dict) -> Walk:
        """A block's walk down all levels that have answers."""
        found: dict[int, list] = {}
        for x in sorted(row["answers"] or [], key=lambda x: (x["level"], x["bucket"])):
            found.setdefault(x["level"], []).append(x)
        way = Walk(row, joined([numbers(x["n"]) for x in found.pop(0, [])], np.int64), model)
        for level, held in enumerate(spread, 1):
            way.go_down(level, found.get(level, []), held.value)
        return way

    def gathered() -> DataFrame:
        every = told[0]
        for t in told[1:]:
            every = every.unionByName(t)
        every = every.where("block_id >= 0").groupBy("block_id").agg(F.collect_list(F.struct("level", "bucket", "spare", "kinds", "n")).alias("answers"))
        return words.select("block_id", *WORDS).join(every, "block_id", "left")

    for level in range(1, reach + 1):
        asking, parts = gathered(), ROUNDS[min(level, len(ROUNDS)) - 1]
        told += [count_level(asking, walk, level, part, parts, bits, divergence) for part in range(parts)]
        spread.append(context.broadcast(hot_sums(told[-parts:])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                way, first, code = walk(row), numbers(row["first"]), numbers(row["code"])

                def by_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(x)])
                    return total[first[1:]] - total[first[:-1]]

                known = by_text((way.counts > 0).astype(np.int64)[code], first) + (texts > 0)
                base = by_text(model.base(way.counts)[code], first) + model.base(np.array([texts]))
                scores = by_text(np.where(way.place > 0, way.score, 0), way.first)
                parts = [np.diff(first) + 1, known, base, scores]
                yield pa.RecordBatch.from_pylist([{"block_id": row["block_id"]} | {c: x.tobytes() for c, x in zip(RESULTS, parts)}])

    results = saved(gathered().mapInArrow(score, "block_id long, " + ", ".join(f"{c} binary" for c in RESULTS)), "scores")

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, *parts in zip(batch["payload"], *[batch[c].to_pylist() for c in RESULTS]):
                n, known, base, scores = (np.frombuffer(x, k) for x, k in zip(parts, (np.int64, np.int64, np.float64, np.float64)))
                added = [n, known, np.full(len(n), model.tokens), base, scores]
                yield pa.RecordBatch.from_arrays([*load(payload.as_buffer()).columns[:-1], *map(pa.array, added)], names)

    return words.select("block_id", "payload").join(results, "block_id").select("payload", *RESULTS).mapInArrow(append, schema)
