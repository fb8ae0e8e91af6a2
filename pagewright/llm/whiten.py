"""Whitening of embeddings by block Jacobi-Davidson, without ever forming the covariance.

Vectors become whole numbers, so counts and sums are exact and every vector can be centred before it is multiplied.
They are packed into blocks in the shared folder; the covariance is only applied, as a distributed product of the
centred vectors with a few columns, of which no more than dimensions x columns numbers come back. The driver holds a
search space of those columns: it takes Ritz pairs from it, lets inner MINRES solve a projected correction equation for each
pair whose residual is too large, and locks pairs from the first one on as they reach double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blocks import saved

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)
BLOCK_ROWS_BYTES = 4 << 20
COMPONENTS = 8
INNER = 8
ROUNDS = 60
Product = Callable[[np.ndarray], np.ndarray]


def usable(columns: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of lists: which rows have numbers only, all finite and fit for whole numbers, and each row's length."""
    lists = columns.cast(pa.list_(pa.float64()))
    size = np.where(lists.is_null(), 0, lists.value_lengths().fill_null(0)).astype(np.int64)
    values = lists.flatten()
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(np.asarray(values.fill_null(np.nan))) * SCALE < LARGEST)
    upto = np.concatenate([[0], np.cumsum(bad)])
    end = np.cumsum(size)
    return (size > 0) & (upto[end] == upto[end - size]), size


def whole(columns: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that count as vectors of d dimensions, and their whole numbers."""
    ok, size = usable(columns)
    rows = np.flatnonzero(ok & (size == d))
    values = np.asarray(columns.take(pa.array(rows)).cast(pa.list_(pa.float64())).flatten())
    return rows, np.floor(values * SCALE).astype(np.int64).reshape(len(rows), d) + SHIFT


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers where they fit, as Python's otherwise."""
    room = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * n + max(map(abs, sums), default=0)
    if room < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return (spread(x, n, sums) / n).astype(np.float64)


def pack_vectors(df: DataFrame, vector: str, d: int) -> DataFrame:
    """(payload, rows) blocks of whole numbers, little-endian 64-bit, row after row."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([len(x)], pa.int64())], ["payload", "rows"])

        for batch in batches:
            _, x = whole(batch.column(0), d)
            for lo in range(0, len(x), step := max(1, BLOCK_ROWS_BYTES // (8 * d))):
                held.append(x[lo : lo + step])
                size += held[-1].nbytes
                if size >= BLOCK_ROWS_BYTES:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return df.select(vector).mapInArrow(blocks, "payload binary, rows long")


def tables(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for payload in batch.column(0):
            yield np.frombuffer(payload.as_buffer(), "<i8").reshape(-1, d)


def summed(blocks: DataFrame, d: int, length: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """Entry by entry, the sum of ``part`` over all blocks. Each task sends ``length`` numbers, Spark adds them up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in tables(batches, d):
            one = part(x)
            total = one if total is None else total + one
        if total is not None:
            values = pa.array(total.ravel()) if kind == "double" else pa.array([str(v) for v in total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length), pa.int32()), values], ["place", "value"])

    rows = blocks.select("payload").mapInArrow(partial, "place int, value " + ("double" if kind == "double" else "string"))
    found = rows.groupBy("place").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()
    out = [0] * length
    for place, value in found:
        out[place] = value
    return out


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to all of ``against`` and each other; what hardly stands out is left out."""
    kept = []
    for v in new.T:
        before = np.linalg.norm(v)
        if before == 0 or not np.isfinite(before):
            continue
        v = v / before
        alone = 1.0
        for _ in range(3):
            for q in (*against, *(k[:, None] for k in kept)):
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            alone *= left
            if alone < 1e-10:
                break
            v = v / left
        else:
            kept.append(v)
    return np.stack(kept, axis=1) if kept else np.empty((len(new), 0))


def corrections(product: Product, theta: np.ndarray, residual: np.ndarray, aside: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """(I - QQ')(V - theta I)(I - QQ') t = -r for each column, Q being ``aside``, by MINRES; all columns share a product.

    A column stops changing once its own residual has fallen by the factor ``enough``.
    """
    project = lambda x: x - aside @ (aside.T @ x)
    v = project(-residual)
    first = beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = v / np.where(live, beta, 1)
    old, x = np.zeros_like(v), np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    left, beta = beta.copy(), np.zeros_like(beta)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        y = project(product(v) - theta * v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - beta * old
        after = np.linalg.norm(y, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, after)
        live &= rho > 0
        safe = np.where(rho > 0, rho, 1)
        w, w_old = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe, w
        c_old, s_old, c, s = c, s, delta / safe, after / safe
        x = x + np.where(live, c * left, 0) * w
        left = np.where(live, -s * left, left)
        live &= (np.abs(left) > enough * first) & (after > 1e-14 * np.abs(theta))
        old, v, beta = v, y / np.where(after > 0, after, 1), after
    return x


def components(product: Product, d: int, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric non-negative operator, their eigenvectors and residuals.

    A pair is locked once its residual is under 40 units in the last place of the largest eigenvalue, and all before it are. A
    residual that rounding keeps above that is accepted once it is under 1000 units and has stopped to fall.
    """
    k = min(k, d)
    width = min(d, k + 4)
    most, least = min(d, 6 * width), min(d, 2 * width)
    space = orthonormal(np.random.default_rng(seed).normal(size=(d, width)))
    image = product(space)
    locked, values, left = np.empty((d, 0)), np.empty(0), np.empty(0)
    best, still = np.inf, 0
    for number in range(ROUNDS):
        theta, y = np.linalg.eigh((h := space.T @ image) / 2 + h.T / 2)
        order = theta.argsort()[::-1]
        theta, y = theta[order], y[:, order]
        ritz, mapped = space @ y[:, : (want := k - locked.shape[1])], image @ y[:, :want]
        residual = mapped - ritz * theta[:want]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        unit = np.finfo(float).eps * max([*values[:1], *theta[:1], 0.0])
        still = still + 1 if size.max(initial=0) > best / 2 else 0
        best = min(best, size.max(initial=0))
        done = size <= (1000 if still >= 3 else 40) * unit
        ready = len(size) if done.all() else int(done.argmin())
        if space.shape[1] + locked.shape[1] >= d and still >= 3:
            ready = len(size)
        if ready:  # what stays of the space is orthogonal to what is locked
            locked, values, left = np.hstack([locked, ritz[:, :ready]]), np.append(values, theta[:ready]), np.append(left, size[:ready])
            rest = y[:, ready : max(least, ready + 1)] if space.shape[1] >= most else y[:, ready:]
            space, image, best, still = space @ rest, image @ rest, np.inf, 0
            ritz, residual, theta = ritz[:, ready:], residual[:, ready:], theta[ready:]
        elif space.shape[1] + len(size) > most:
            space, image = space @ y[:, :least], image @ y[:, :least]
        if locked.shape[1] >= k:
            order = values.argsort(kind="stable")[::-1]
            return values[order], locked[:, order], left[order]
        size = size[ready:]
        active = size > 40 * unit
        aside = orthonormal(np.hstack([locked, ritz]))
        step = corrections(product, theta[: len(size)][active], residual[:, active], aside, INNER, 0.5 ** min(number + 1, 10))
        step = orthonormal(step, locked, space)
        if not step.shape[1]:  # rounding leaves nothing to add: any new direction keeps the space growing
            step = orthonormal(np.random.default_rng(seed + number + 1).normal(size=(d, 2)), locked, space)
        if step.shape[1]:
            space, image = np.hstack([space, step]), np.hstack([image, product(step)])
        else:  # the space is whole; products are taken anew
            image = product(space)
    raise ArithmeticError(f"{k - locked.shape[1]} of {k} components have not reached double precision in {ROUNDS} rounds")


def whiten(df: DataFrame, vector: str = "embedding", *, k: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: component, n, deviation, whitened, explained and identity_error.

    An entry c becomes floor(1024 * c) + 100000. Rows go whose vector is null, is empty, holds a null or non-finite
    entry or one of 2**42 or more, or has another length than most vectors (ties: the longer one). The rest are the fit
    list; repeated rows count as often as they stand there. deviation is exact, and null where it doesn't fit a long. There are
    k components, fewer with fewer dimensions; a component without variance (under d units in the last place of the
    first) can't be whitened and has no rows, so equal vectors or a single one give none, and neither does an empty table.
    A component's largest entry is positive. Other columns stay; columns of the six names are replaced.
    """
    spark = df.sparkSession
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    df = df.drop(*[c for c in made if c != vector])

    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            ok, size = usable(column)
            yield pa.array(np.where(ok, size, 0), pa.int64())

    sizes = df.select(F.arrow_udf(lengths, "long")(F.col(vector)).alias("size")).where("size > 0").groupBy("size").count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    shape = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return df.limit(0).select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in shape.split(", ")])
    d = most[0]
    blocks = saved(pack_vectors(df, vector, d), "vectors")

    def moments(x: np.ndarray) -> np.ndarray:
        high, low = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        return np.append(high * (1 << 32) + low, np.array([len(x)], object))

    *sums, n = map(int, summed(blocks, d, d + 1, moments, "decimal(38,0)"))

    def product(q: np.ndarray) -> np.ndarray:
        out = summed(blocks, d, q.size, lambda x: (c := centred(x, n, sums)).T @ (c @ q))
        return np.array(out, float).reshape(q.shape) / n

    values, basis, _ = components(product, d, k)
    seen = values > d * np.finfo(float).eps * values.max(initial=0)
    values, basis = values[seen], basis[:, seen]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    scaled = basis / np.sqrt(values)

    def spreads(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        w = c @ scaled
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [(c * c).sum()]])

    m = len(values)
    *found, trace = summed(blocks, d, m * m + m + 1, spreads)
    mean = np.array(found[m * m :], float) / n
    cov = np.array(found[: m * m], float).reshape(m, m) / n - np.outer(mean, mean)
    error = float(np.abs(cov - np.eye(m)).max(initial=0))
    explained = values / (trace / n) if m else values
    parts = pa.list_(pa.struct([("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())]))

    def rows(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            at, x = whole(column, d)
            far = spread(x, n, sums)
            total = (far.astype(object) ** 2).sum(axis=1)
            w = (far / n).astype(float) @ scaled
            count = np.zeros(len(column) + 1, np.int64)
            count[at + 1] = m
            flat = pa.StructArray.from_arrays(
                [pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))), pa.array([int(t) if t < 1 << 63 else None for t in total for _ in range(m)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, len(at)))],
                fields=list(parts.value_type),
            )
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), flat, type=parts)

    kind = "array<struct<component: int, deviation: long, whitened: double, explained: double>>"
    out = df.withColumn("__parts", F.arrow_udf(rows, kind)(F.col(vector))).withColumn("__part", F.explode("__parts"))
    return out.select(*df.columns, "__part.component", F.lit(n).cast("long").alias("n"), "__part.deviation", "__part.whitened", "__part.explained", F.lit(error).alias("identity_error"))
