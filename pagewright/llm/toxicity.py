"""Toxicity by subword bags: embeddings of character n-grams, averaged, into a linear softmax.

A word stands for its n-grams of bytes, its edges included, each hashed to a row of one embedding table. A misspelt word
shares most n-grams with the right one, and so their vectors. A window of words is the mean of its n-grams' vectors; table
and softmax are trained together in numpy. A text is as toxic as its most toxic window, so a few words count in a
text of any length, and training ends on the most toxic windows of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.words import LOWER, chunks, flat, spans

GRAMS = (3, 4, 5, 6)
BUCKETS = 65_535  # one more index, the last, is for places without an n-gram
EMBEDDING = 8
WINDOW, STEP = 5, 2
LEAST_TEXTS, LEAST_SHARE, FREQUENT = 3, 0.002, 0.5
LEAST_GRAMS = 100
TOP, SPACING = 8, 40
SAMPLE = 1500
LONGEST = 16 << 10
PIECE = 1 << 19  # bytes of text scored at once
PIECE_WORDS = 40_000  # of a longer text, a multiple of STEP
_FACTOR = np.uint32(0x01000193)


class Bags(NamedTuple):
    grams: np.ndarray  # places x len(GRAMS): bucket of the n-gram that starts there
    word: np.ndarray  # first place of each word, and the number of places
    text: np.ndarray  # first word of each text, and the number of words


class Classifier(NamedTuple):
    embedding: np.ndarray  # BUCKETS + 1 x EMBEDDING, the last row zero
    dense: np.ndarray  # EMBEDDING x 2
    shift: np.ndarray  # 2

    def scores(self) -> np.ndarray:
        """What each bucket adds to the log odds: the softmax over two labels is linear in the mean."""
        return (self.embedding @ (self.dense[:, 1] - self.dense[:, 0])).astype(np.float32)

    def bias(self) -> float:
        return float(self.shift[1] - self.shift[0])


def bags(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Bags:
    """The n-grams of words from start to end, lower-cased; every word is written between blanks, which n-grams may begin or end with."""
    if not len(start):
        return Bags(np.empty((0, len(GRAMS)), np.uint16), np.zeros(1, np.int64), first)
    size = end - start + 1  # the blank before it
    word = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(start - 1 - word[:-1], size) + np.arange(word[-1])
    stream = np.empty(word[-1] + max(GRAMS), np.uint8)
    stream[word[-1] :] = 0x20
    stream[: word[-1]] = LOWER[buf[np.maximum(source, 0)]]
    stream[word[:-1]] = 0x20
    edge = stream == 0x20
    n = int(word[-1])
    out = np.full((n, len(GRAMS)), BUCKETS, np.uint16)
    h = stream[:n].astype(np.uint32) + np.uint32(1)
    whole = np.ones(n, bool)
    for width in range(2, max(GRAMS) + 1):
        h = h * _FACTOR ^ stream[width - 1 : n + width - 1]
        if width > 2:
            whole &= ~edge[width - 2 : n + width - 2]
        if width in GRAMS:
            x = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            x = (x ^ x >> np.uint32(13)) % np.uint32(BUCKETS)
            np.copyto(out[:, GRAMS.index(width)], x.astype(np.uint16), where=whole)
    return Bags(out, word, first)


def windows(b: Bags, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all words of each text: first word, word after the last, and the text."""
    n = np.diff(b.text)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    lo = b.text[text] + number * step
    return lo, np.minimum(lo + WINDOW, b.text[text + 1]), text


def rated(b: Bags, scores: np.ndarray, bias: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows with their log odds, by text and from the most toxic one on: text, log odds, first word, word after the last."""
    first, last, text = windows(b, step)
    total = np.zeros(len(b.grams) + 1)
    held = np.zeros(len(b.grams) + 1, np.int32)
    for j in range(len(GRAMS)):
        total[1:] += scores[b.grams[:, j]]
        held[1:] += b.grams[:, j] < BUCKETS
    np.cumsum(total, out=total)
    np.cumsum(held, out=held)
    a, z = b.word[first], b.word[last]
    value = bias + (total[z] - total[a]) / np.maximum(LEAST_GRAMS, held[z] - held[a])
    order = np.lexsort((first, -value, text))
    return text[order], value[order], first[order], last[order]


def odds(b: Bags, scores: np.ndarray, bias: float) -> np.ndarray:
    """For each text, the largest log odds of its windows; a text without words has the bias."""
    best = np.full(len(b.text) - 1, bias)
    text, value, _, _ = rated(b, scores, bias, STEP)
    top = np.flatnonzero(np.diff(text, prepend=-1))
    best[text[top]] = value[top]
    return best


def pairs(b: Bags, lo: np.ndarray, hi: np.ndarray, rare: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all n-grams in words lo to hi of each text, or of all different ones; not of buckets where ``rare`` is true.

    Made for some texts at a time, so little more is held than what is returned.
    """
    size = b.word[hi] - b.word[lo]
    upto = np.concatenate([[0], np.cumsum(size)])
    owns, buckets = [np.empty(0, np.int32)], [np.empty(0, np.uint16)]
    row = 0
    while row < len(lo):
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + (1 << 18), "right")) - 1)
        part = slice(row, stop)
        own = np.repeat(np.arange(row, stop), size[part])
        place = np.arange(upto[row], upto[stop]) - np.repeat(upto[row:stop] - b.word[lo[part]], size[part])
        bucket = b.grams[place].ravel().astype(np.int64)
        own = np.repeat(own, len(GRAMS))
        if once:
            key = np.unique(own * (BUCKETS + 1) + bucket)
            own, bucket = key // (BUCKETS + 1), key % (BUCKETS + 1)
        use = ~rare[bucket]
        owns.append(own[use].astype(np.int32))
        buckets.append(bucket[use].astype(np.uint16))
        row = stop
    return np.concatenate(owns), np.concatenate(buckets)


def descend(net: Classifier, own: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int, shrink: float) -> Classifier:
    """Gradient descent over all texts at once on weighted cross entropy and squared sizes, with Nesterov's momentum; what doesn't help is taken back.

    With two labels the loss depends on one log odds a text, so all gradients follow from one number for each bucket.
    """
    share = 1 / np.maximum(LEAST_GRAMS, np.bincount(own, minlength=len(toxic)))
    sign = 2.0 * toxic - 1

    def loss(net: Classifier) -> tuple[float, np.ndarray]:
        z = net.bias() + np.bincount(own, net.scores()[bucket], len(toxic)) * share
        cost = weight @ np.logaddexp(0, -sign * z) + shrink / 2 * ((net.embedding**2).sum() + (net.dense**2).sum())
        return float(cost), -weight * sign / (1 + np.exp(np.clip(sign * z, -500, 500)))

    rate, before, going, now = 1.0, net, 0, loss(net)[0]
    for _ in range(steps):
        ahead = Classifier(*[p + going / (going + 3) * (p - q) for p, q in zip(net, before)])
        _, delta = loss(ahead)
        pull = np.bincount(bucket, (delta * share)[own], BUCKETS + 1)
        axis = ahead.dense[:, 1] - ahead.dense[:, 0]
        back = ahead.embedding.T @ pull
        grads = (np.outer(pull, axis) + shrink * ahead.embedding, np.stack([-back, back], axis=1) + shrink * ahead.dense, np.array([-1, 1]) * delta.sum())
        new = Classifier(*[p - rate * g for p, g in zip(ahead, grads)])
        cost, _ = loss(new)
        if cost < now:
            before, net, now, going, rate = net, new, cost, going + 1, rate * 1.3
        else:
            before, going, rate = net, 0, rate / (2 if going == 0 else 1.3)
    return net


def chosen(b: Bags, net: Classifier) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most toxic windows of each text, which don't overlap: text, first word, word after the last.

    A text gives one window and one more for each SPACING words, TOP at most, so that the words of a toxic text that are not yet known
    for toxic are seen beside those that are.
    """
    text, _, lo, hi = rated(b, net.scores(), net.bias(), WINDOW)
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    use = rank < np.minimum(TOP, 1 + np.diff(b.text)[text] // SPACING)
    return text[use], lo[use], hi[use]


def train(b: Bags, toxic: np.ndarray, weight: np.ndarray, *, steps: int = 60, rounds: int = 8, shrink: float = 1e-5, seed: int = 11) -> Classifier:
    """Table and softmax together: first over whole texts, then over each text's most toxic windows, chosen anew each round.

    Rows start near zero. N-grams in few or very many texts keep a row of zeros and are not learnt. At the end the log odds are scaled
    and shifted to fit texts that were held back (every fifth), so a probability means the same on new texts.
    """
    rng = np.random.default_rng(seed)
    weight = weight / max(1e-300, weight.sum())
    texts = len(b.text) - 1
    back = np.arange(texts) % 5 == 4 if texts >= 50 else np.zeros(texts, bool)
    learn = np.where(back, 0.0, weight)
    own, bucket = pairs(b, b.text[:-1], b.text[1:], np.arange(BUCKETS + 1) == BUCKETS, True)
    count = np.bincount(bucket[~back[own]], minlength=BUCKETS + 1)
    rare = (count < max(LEAST_TEXTS, LEAST_SHARE * texts)) | (count > FREQUENT * max(1, (~back).sum()))
    rare[-1] = True
    embedding = np.where(rare[:, None], 0, rng.normal(0, 1e-3, (BUCKETS + 1, EMBEDDING)))
    net = Classifier(embedding, rng.normal(0, 1, (EMBEDDING, 2)), np.zeros(2))
    use = ~rare[bucket] & ~back[own]
    own, bucket = own[use], bucket[use]
    net = descend(net, own, bucket, toxic, learn, steps, shrink)
    del own, bucket, use
    for _ in range(rounds):
        text, lo, hi = chosen(b, net)
        share = learn[text] / np.bincount(text, minlength=texts)[text]
        net = descend(net, *pairs(b, lo, hi, rare, False), toxic[text], share, 10, shrink)
    z = odds(b, net.scores(), net.bias())
    fit = back if len(set(toxic[back])) == 2 else np.ones(texts, bool)
    slope, shift = calibrated(z[fit], toxic[fit], weight[fit])
    return Classifier(net.embedding, net.dense * slope, np.array([0.0, net.bias() * slope + shift]))


def calibrated(z: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope over 0 and shift of the log odds that fit the labels best, by Newton's method with a little shrinkage."""
    if len(set(toxic)) < 2:
        return 1.0, 0.0
    middle, scale = np.median(z), max(1e-9, z.std())
    x, at = np.stack([(z - middle) / scale, np.ones(len(z))], axis=1), np.zeros(2)
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        grad = x.T @ (weight * (p - toxic)) + 1e-4 * at
        at = at - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), grad)
    slope = max(1e-3, at[0]) / scale
    return slope, at[1] - slope * middle


def text_odds(column: pa.Array, scores: np.ndarray, bias: float) -> np.ndarray:
    """odds() of every whole text of a column; a long text is gone through by overlapping ranges of words."""
    out = []
    for _, piece in chunks(column, PIECE):
        buf, at = flat(piece)
        start, end, first = spans(buf, at)
        if len(piece) > 1 or len(start) <= PIECE_WORDS:
            out.append(odds(bags(buf, start, end, first), scores, bias))
            continue
        best = bias
        for a in range(0, len(start), PIECE_WORDS):
            z = min(len(start), a + PIECE_WORDS + WINDOW)
            part = odds(bags(buf, start[a:z], end[a:z], np.array([0, z - a])), scores, bias)[0]
            best = part if a == 0 else max(best, part)
        out.append(np.array([best]))
    return np.concatenate(out) if out else np.empty(0)


def training_texts(df: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> tuple[pa.Table, dict[int, int]]:
    """At most ``sample`` labelled texts of each label, the first by hash, and the number of labelled rows of each label.

    The labels are counted whole. The keys picked are at most twice ``sample`` a label, so they are broadcast, and texts are not shuffled.
    """
    labelled = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    counts = {r[0]: r[1] for r in labelled.groupBy("__label").count().collect()}
    h = F.shiftrightunsigned(F.xxhash64("__key"), 1)
    rate = F.when(F.col("__label") == 0, min(1.0, 3.0 * sample / max(1, counts.get(0, 0)))).otherwise(min(1.0, 3.0 * sample / max(1, counts.get(1, 0))))
    near = labelled.where(h < rate * float(1 << 63)).withColumn("__h", h)
    number = F.row_number().over(Window.partitionBy("__label").orderBy("__h", "__key"))
    keys = near.withColumn("__n", number).where(F.col("__n") <= 2 * sample).drop("__n")
    texts = df.where(F.octet_length(text) <= LONGEST).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    number = F.row_number().over(Window.partitionBy("__label").orderBy("__h", "__text"))
    picked = texts.join(F.broadcast(keys), "__key").withColumn("__n", number).where(F.col("__n") <= sample)
    return picked.select("__h", "__text", "__label").toArrow().sort_by([("__h", "ascending"), ("__label", "ascending"), ("__text", "ascending")]), counts


def detect(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", *, sample: int = SAMPLE) -> DataFrame:
    """Add score, the probability of label 1 (0 to 1), to every row.

    The classifier learns from ``labels`` (key and label; labels other than 0 and 1 and null keys are left out): of each label, at most
    ``sample`` texts of at most LONGEST bytes, weighted so that both labels count as in all of ``labels``. A key labelled twice is two examples.
    Scores see nothing but the text, and all of it. Null and empty texts and those of blanks get the score of no n-gram at all.
    Without any labelled text all scores are 0. Reruns agree, equal texts get equal scores, other columns stay, and a column
    named score is replaced.
    """
    table, counts = training_texts(df, labels, text, key, label, sample)
    toxic = np.asarray(table["__label"], np.int64)
    taken = np.bincount(toxic, minlength=2)
    weight = np.array([counts.get(i, 0) / max(1, taken[i]) for i in (0, 1)])[toxic]
    buf, at = flat(table["__text"])
    net = train(bags(buf, *spans(buf, at)), toxic, weight)
    held = df.sparkSession.sparkContext.broadcast((net.scores(), net.bias() if len(toxic) else -np.inf))

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            z = text_odds(column, *held.value)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) * (z > -np.inf))

    return df.withColumn("score", F.arrow_udf(score, "double")(F.col(text)))
