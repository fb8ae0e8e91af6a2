"""Language ID by a byte convolutional network, trained in numpy on labelled text.

A window of bytes goes through filters of several widths over learnt byte embeddings, each filter keeps its largest
response in the window, and a softmax layer names the language. Texts are cut into fixed-length windows that cover them
whole; a text's probabilities are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.blocks import thrifty
from pagewright.llm.words import chunks, flat

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
SAMPLE = 1200
UNKNOWN = "und"


class ByteNet(NamedTuple):
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # of each width: width x EMBEDDING x FILTERS
    bias: np.ndarray  # a bias for each filter of all widths
    dense: np.ndarray  # all filters x labels
    shift: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width, the response of each of its places to each byte: width x 256 x FILTERS."""
        return [np.einsum("be,wef->wbf", self.embedding, w) for w in self.filters]


def pooled(windows: np.ndarray, tables: list[np.ndarray], pairs: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each window, before the bias, and where it was.

    windows: n x length bytes. Two places of a filter that stand side by side are looked up together, as one table
    over byte pairs, which halves the work.
    """
    best, where = [], []
    n, length = windows.shape
    two = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
    for i, table in enumerate(tables):
        width = len(table)
        span = length - width + 1
        out = None
        for place in range(0, width, 2):
            if place + 1 < width:
                joint = pairs[i][place // 2] if pairs else (table[place][:, None] + table[place + 1][None]).reshape(65536, -1)
                part = np.take(joint, two[:, place : place + span], axis=0)
            else:
                part = np.take(table[place], windows[:, place : place + span], axis=0)
            out = part if out is None else np.add(out, part, out=out)
        at = out.argmax(axis=1) if pairs is None else np.empty((n, 0), np.int64)
        best.append(np.take_along_axis(out, at[:, None], axis=1)[:, 0] if pairs is None else out.max(axis=1))
        where.append(at)
    return np.concatenate(best, axis=1), np.concatenate(where, axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_net(windows: np.ndarray, target: np.ndarray, labels: list[str], *, widths: tuple[int, ...] = WIDTHS, n_filters: int = FILTERS, size: int = EMBEDDING, epochs: int = 10, least_steps: int = 1500, batch: int = 32, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Adam on cross entropy. Only the largest response of a filter passes a gradient back, to the bytes it covers.

    In each round every other window is cut at a random length, as short texts are, and the rate falls to nothing.
    """
    rng = np.random.default_rng(seed)
    net = ByteNet(
        labels, rng.normal(0, 0.5, (256, size)).astype(np.float32), [rng.normal(0, 1 / np.sqrt(w * size), (w, size, n_filters)).astype(np.float32) for w in widths],
        np.zeros(n_filters * len(widths), np.float32), rng.normal(0, 0.3, (n_filters * len(widths), len(labels))).astype(np.float32), np.zeros(len(labels), np.float32),
    )
    params = [net.embedding, *net.filters, net.bias, net.dense, net.shift]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    a_round = -(-len(windows) // batch)
    epochs = max(epochs, -(-least_steps // max(1, a_round)))
    steps = epochs * a_round + 1
    for _ in range(epochs if len(windows) else 0):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            x, y = windows[rows], target[rows]
            length = np.where(rng.random(len(rows)) < 0.5, rng.integers(8, x.shape[1] + 1, len(rows)), x.shape[1])
            x = np.where(np.arange(x.shape[1]) < length[:, None], x, 0).astype(np.uint8)
            high, where = pooled(x, net.tables())
            hidden = np.maximum(high + net.bias, 0)
            delta = softmax(hidden @ net.dense + net.shift)
            delta[np.arange(len(rows)), y] -= 1
            delta /= len(rows)
            back = (delta @ net.dense.T) * (hidden > 0)
            grads = [np.zeros_like(net.embedding), *[np.zeros_like(w) for w in net.filters], back.sum(0), hidden.T @ delta, delta.sum(0)]
            for i, w in enumerate(net.filters):
                own = slice(i * n_filters, (i + 1) * n_filters)
                for place in range(len(w)):
                    byte = x[np.arange(len(rows))[:, None], where[:, own] + place]
                    grads[1 + i][place] = np.einsum("rfe,rf->ef", net.embedding[byte], back[:, own])
                    np.add.at(grads[0], byte, back[:, own][:, :, None] * w[place].T[None])
            step += 1
            for p, g, m, s in zip(params, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def text_windows(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows, the last of each filled with zeros: windows, their text, their bytes of text."""
    size = np.diff(at)
    count = (size + length - 1) // length
    text = np.repeat(np.arange(len(size)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    number = np.arange(len(text)) - first[text]
    held = np.minimum(length, size[text] - number * length)
    start = at[text] + number * length
    padded = np.concatenate([buf, np.zeros(length, np.uint8)])
    windows = padded[start[:, None] + np.arange(length)]
    windows[np.arange(length) >= held[:, None]] = 0
    return windows, text, held


def training_windows(df: DataFrame, lang: str, text: str, key: Column, sample: int, window: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most ``sample`` windows a language, each from a place of a text that its hash picks.

    Rates come from counts over all labelled rows; of the windows picked, the first ``sample`` different ones of each
    language by hash reach the driver, so reruns agree and repeated rows count once.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return [], np.empty((0, window), np.uint8), np.empty(0, np.int64)
    rate = F.lit(0.0)
    for name, n in counts.items():
        rate = F.when(F.col(lang) == name, min(1.0, 1.3 * sample / n)).otherwise(rate)
    h = F.xxhash64(key, F.length(text))
    place = F.pmod(F.shiftrightunsigned(h, 20), F.greatest(F.lit(1), F.length(text) - window + 1)).cast("int") + 1
    picked = labelled.where(F.shiftrightunsigned(h, 1) < rate * float(1 << 63)).select(lang, h.alias("h"), F.substring(F.col(text), place, F.lit(window)).alias("part"))
    number = F.row_number().over(Window.partitionBy(lang).orderBy("h", "part"))
    rows = picked.distinct().withColumn("number", number).where(F.col("number") <= sample).toArrow().sort_by([("h", "ascending"), ("part", "ascending")])
    labels = sorted(counts)
    windows, target = [np.empty((0, window), np.uint8)], []
    for i, name in enumerate(labels):
        part = rows.filter(pa.compute.equal(rows[lang], name)).slice(0, sample)["part"]
        found, own, _ = text_windows(*flat(part), window)
        once = np.flatnonzero(np.diff(own, prepend=-1))  # non-ASCII letters make a part longer than a window
        windows.append(found[once])
        target += [i] * len(once)
    return labels, np.concatenate(windows), np.array(target, np.int64)


def identify(
    df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", *, sample: int = SAMPLE, window: int = WINDOW,
) -> DataFrame:
    """Add lang_pred and score (its probability, 0 to 1) to every row.

    The network learns from rows with ``learn`` true and a language, from a sample of at most ``sample`` windows a
    language; ``key`` only picks the sample. A prediction sees nothing but the text. Texts that are null or have no
    letter get ``und`` and 0, and so do all texts if there is nothing to learn from. Reruns agree, repeated rows get
    equal predictions, and other columns stay; columns of the two names are replaced.
    """
    labels, windows, target = training_windows(df.where(learn), lang, text, F.col(key), sample, window)
    net = train_net(windows, target, labels)
    held = df.sparkSession.sparkContext.broadcast(net)
    shape = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @thrifty
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = held.value
        tables = net.tables()
        pairs = [[(t[p][:, None] + t[p + 1][None]).reshape(65536, -1) for p in range(0, len(t) - 1, 2)] for t in tables]
        for column in columns:
            names, scores = [], []
            for _, piece in chunks(column, 1 << 19):
                x, own, size = text_windows(*flat(piece), window)
                total = np.zeros((len(piece), max(1, len(net.labels))))
                if net.labels:
                    for lo in range(0, len(x), 256):
                        high, _ = pooled(x[lo : lo + 256], tables, pairs)
                        p = softmax(np.maximum(high + net.bias, 0) @ net.dense + net.shift)
                        np.add.at(total, own[lo : lo + 256], p * size[lo : lo + 256, None])
                weight = total.sum(axis=1)
                best = total.argmax(axis=1)
                ok = weight > 0
                scores += np.where(ok, total[np.arange(len(total)), best] / np.where(ok, weight, 1), 0.0).tolist()
                names += [net.labels[b] if o else UNKNOWN for b, o in zip(best, ok)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.minimum(scores, 1.0), pa.float64())], fields=list(shape))

    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    guess = F.arrow_udf(predict, "struct<lang_pred: string, score: double>")(lettered)
    out = df.withColumn("__guess", guess)
    return out.withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")
