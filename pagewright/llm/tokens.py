"""Token counts by byte-pair merging, without making the tokens.

A text is cut at special strings and by the vocabulary's splitting pattern. Within a piece the adjacent pair of
lowest rank is merged again and again: a heap holds the pairs, two arrays link each symbol to its neighbours, and
the count is the number of bytes less the number of merges. Pieces repeat, so a task keeps their counts.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public splitting pattern of byte-level BPE, with Unicode White_Space written out for \s.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_merges(path: str) -> tuple[dict[int, int], list[str]]:
    """From a tokenizers .json file: ranks of mergeable pairs (left symbol << 20 | right symbol) and special strings.

    A byte is symbol 0 to 255; the merge of rank r makes symbol 256 + r.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbol = byte_letters()
    ranks = {}
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ranks[symbol[left] << 20 | symbol[right]] = rank
        symbol.setdefault(left + right, 256 + rank)
    return ranks, [t["content"] for t in spec["added_tokens"] if t["special"]]


def symbols_left(piece: bytes, ranks: dict[int, int]) -> int:
    """How many symbols a piece has when no adjacent pair can be merged any more."""
    n = len(piece)
    symbol = list(piece)
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbol[i] << 20 | symbol[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        best = heapq.heappop(heap)
        rank, i = best >> 32, best & 0xFFFFFFFF
        j = after[i]
        if symbol[i] < 0 or j >= n or ranks.get(symbol[i] << 20 | symbol[j]) != rank:
            continue  # one of the two has been merged meanwhile
        symbol[i], symbol[j] = 256 + rank, -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(symbol[i] << 20 | symbol[k])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbol[h] << 20 | symbol[i])
            if rank is not None:
                heapq.heappush(heap, rank << 32 | h)
    return left


class PieceCounts(dict):
    """Counts of pieces, worked out when first asked for."""

    def __init__(self, ranks: dict[int, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = self[piece] = symbols_left(piece.encode(), self.ranks)
        return n


def count_tokens(df: DataFrame, text: str = "text", *, tokenizer: str, remember: int = 300_000) -> DataFrame:
    """Add n_bytes (UTF-8) and n_tokens for the byte-level BPE file at ``tokenizer``.

    Null counts as the empty text: 0 bytes, 0 tokens. A special string of the file counts as one token wherever it
    stands. Nothing is truncated. Repeated rows count alike, and no rows give none. Columns already called n_bytes
    or n_tokens are replaced; others stay. A task forgets the counts of pieces whenever it has ``remember`` of them, which
    bounds its memory and leaves results as they are. The merge table is sent to the executors; its size is that of
    the tokenizer file.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(read_merges(tokenizer))

    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, special = held.value
        pieces = regex.compile(PIECES)
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        known = PieceCounts(ranks)
        for column in columns:
            out = []
            for value in column:
                value = value.as_py() or ""
                n, parts = 0, [value]
                if cut and cut.search(value):
                    parts = cut.split(value)
                    n = len(parts) - 1
                for part in parts:
                    n += sum(map(known.__getitem__, pieces.findall(part)))
                    if len(known) > remember:
                        known.clear()
                out.append(n)
            yield pa.array(out, pa.int64())

    counted = F.arrow_udf(count, "long")
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": counted(whole)})
