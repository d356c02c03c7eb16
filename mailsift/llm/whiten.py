"""Embedding whitening: principal directions by a blockwise QR, a bidiagonal qd solver and twisted factorisations.

Entries become whole numbers, floor(1024 * c) + 100000, so the number of rows n and each dimension's
sum S are exact. Every task centres its rows and folds them, block by block, into one triangle R of
d by d numbers (QR of R above the next block); triangles are folded the same way in groups of
``FAN`` until one is left, whose R'R is the centred sum of squares, never formed as such. The driver
holds d by d numbers whatever the number of rows: it makes R bidiagonal by Householder reflections,
finds the squares of its singular values by the dqds iteration, to high relative accuracy, and for
each wanted one the singular vector by a twisted factorisation of B'B - s I; values that stand too
close for that get their vectors by inverse iteration, orthogonal to each other. Rows are then projected
in one pass, and the whitened values' own covariance is summed up in another.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped, and so
are vectors of another length than most have (of equally frequent lengths the longest counts); a component
without spread (its eigenvalue under 1e-20 of the trace) has no whitened value and is left out, so one row, or equal rows,
have none; repeated rows count as often as they stand, a null vec_id is an id like others; entries beyond
2^42 are cut to that, as their whole numbers would not fit; a deviation that does not fit a long is null; an empty table gives an empty one.
Other columns, whatever their names, come through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, table

COMPONENTS = 8
BLOCK, FAN = 4096, 16
SCALE, OFFSET, FAR = 1024.0, 100_000, float(2**52)
TINY = 1e-20
EPS = np.finfo(float).eps
#: A coupling under (100 EPS)^2 of its neighbours is none; after each 30 steps without a deflation ten times as much.
LOOSE, PATIENCE = (100 * EPS) ** 2, 30
CLOSE = 1e-6


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U' r W for orthogonal U and W, and W."""
    a, d = r.astype(float).copy(), r.shape[1]
    w = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size else v

    for k in range(d):
        v = mirror(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = mirror(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal (a, b), falling: shifted quotient differences, deflated from the end."""
    q, e = (a * a).tolist(), (b * b).tolist()
    found: list[float] = []
    todo = [(q, e, 0.0)]
    while todo:
        q, e, shift = todo.pop()
        guess, stuck, steps = 0.0, 0, 0
        while len(q) > 1:
            n, most = len(q), LOOSE * 10.0 ** (steps // PATIENCE)
            steps += 1
            if e[-1] <= most * (shift + q[-1]) or e[-1] <= 1e-300:
                found.append(shift + q.pop())
                e.pop()
                guess, steps = 0.0, 0
                continue
            gap = next((i for i in range(n - 2, -1, -1) if e[i] <= most * (shift + min(q[i], q[i + 1]))), None)
            if gap is not None:  # two blocks that don't touch
                todo.append((q[: gap + 1], e[:gap], shift))
                q, e, guess, steps = q[gap + 1 :], e[gap + 1 :], 0.0, 0
                continue
            # One step, from a shift that must stay below the least value; zero always does.
            while True:
                new_q, new_e, d, least = [0.0] * n, [0.0] * (n - 1), q[0] - guess, q[0] - guess
                good = d >= 0
                for i in range(n - 1):
                    if not good:
                        break
                    new_q[i] = d + e[i]
                    t = q[i + 1] / new_q[i] if new_q[i] else 0.0
                    new_e[i] = e[i] * t
                    d = d * t - guess
                    least = min(least, d)
                    good = d >= 0
                if good:
                    break
                stuck += 1
                guess = guess * 0.25 if stuck < 8 else 0.0
            new_q[-1] = d
            q, e = new_q, new_e
            shift += guess
            # Beneath the corner's least value by its coupling to the rest, or nothing.
            x, y = q[-1], e[-1] if e else 0.0
            guess = max(0.0, least - (y + np.sqrt(max(0.0, x * y)))) if y < x else 0.25 * least if stuck < 8 else 0.0
            stuck = 0 if guess == 0 else stuck
        if q:
            found.append(shift + q[0])
    return np.sort(np.array(found))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The right singular vector of the bidiagonal (a, b) for a squared singular value: B'B - value I from both ends, twisted where they meet best."""
    n = len(a)
    d, low = a * a, b / a[:-1]  # B'B = L D L'
    tiny = EPS * EPS * max(value, d.max())
    s, p = np.empty(n), np.empty(n)
    fore, back = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        fore[i] = d[i] * low[i] / pivot
        s[i + 1] = fore[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        back[i] = low[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -fore[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -back[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest k eigenvalues of r'r with spread, their unit vectors in columns, and the sum of all eigenvalues."""
    a, b, w = bidiagonal(r)
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if not top:
        return np.zeros(0), np.zeros((r.shape[1], 0)), 0.0
    values = dqds(a, b)
    total = float(values.sum())
    values = values[:k][values[:k] > TINY * total]
    a = np.where(np.abs(a) < EPS * EPS * top, EPS * EPS * top, a)  # a zero on the diagonal has no quotient
    tri = None
    out: list[np.ndarray] = []
    first = 0
    for i, x in enumerate(values):
        if i and values[i - 1] - x > CLOSE * values[i - 1]:
            first = i
        v = twisted(a, b, float(x)) if len(a) > 1 else np.ones(1)
        if i > first or (i + 1 < len(values) and x - values[i + 1] <= CLOSE * x):
            # Close to its neighbour: inverse iteration across those before.
            if tri is None:
                full = np.diag(a) + np.diag(b, 1)
                tri = full.T @ full
            v = np.random.default_rng(i).standard_normal(len(a))
            for _ in range(4):
                for u in out[first:i]:
                    v -= u * (u @ v)
                v = np.linalg.solve(tri - (x * (1 + 4 * EPS)) * np.eye(len(a)) + EPS * x * np.eye(len(a)), v / np.linalg.norm(v))
                for _ in range(2):
                    for u in out[first:i]:
                        v -= u * (u @ v)
                v /= np.linalg.norm(v)
        out.append(v)
    return values, w @ np.array(out).T if out else np.zeros((len(a), 0)), total


def fold(upper: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The triangle of the rows so far and of the block's."""
    return np.linalg.qr(block if upper is None else np.vstack([upper, block]), mode="r")


def whole(part: pa.RecordBatch) -> np.ndarray:
    """The batch's vectors as rows of whole numbers."""
    v = part.column("_v")
    flat = np.asarray(v.flatten(), dtype=float)
    x = np.floor(np.clip(flat * SCALE, -FAR, FAR)).astype(np.int64) + OFFSET
    return x.reshape(len(v), -1) if len(v) else x.reshape(0, 0)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """(row, _v): the rows with a usable vector, as doubles."""
    rows = df.select(F.struct("*").alias("row"), F.col(name).cast("array<double>").alias("_v")).filter(F.size("_v") > 0)
    return rows.filter(F.forall("_v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))


def _triangles(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary())], ["r"])


def _triangle(x: bytes, d: int) -> np.ndarray:
    return np.frombuffer(x, "<f8").reshape(-1, d)


def fit(rows: DataFrame) -> dict | None:
    """n, exact sums, directions, eigenvalues and trace of the rows' covariance; None without rows. rows: (row, _v) of one length."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for part in parts:
            if len(part):
                x = whole(part)
                n, s = n + len(x), x.sum(axis=0) if s is None else s + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(np.full(len(s), n))], ["at", "s", "n"])

    vectors = rows.select("_v")
    found = map_batches(vectors, sums, "at int, s long, n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    if not found:
        return None
    n, s = found[0].n, np.array([r.s for r in found], np.int64)
    d = len(s)

    def centred(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for part in parts:
            x = whole(part)
            for i in range(0, len(x), BLOCK):
                upper = fold(upper, centre(x[i : i + BLOCK], n, s))
        if upper is not None:
            yield _triangles(upper)

    def folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for part in parts:
            for r in part.column("r").to_pylist():
                upper = fold(upper, _triangle(r, d))
        if upper is not None:
            yield _triangles(upper)

    parts = cut(map_batches(vectors, centred, "r binary"), "triangles")
    left = parts.count()
    while left > 1:
        groups = -(-left // FAN)
        parts = cut(map_batches(parts.repartition(groups), folded, "r binary"), "triangles")
        left = min(groups, parts.count())
    r = _triangle(bytes(parts.first().r), d)
    values, vectors, total = directions(np.linalg.qr(r, mode="r") if len(r) > d else np.vstack([r, np.zeros((d - len(r), d))]))
    return {"n": n, "s": s, "vectors": vectors, "values": values / n, "trace": total / n}


def centre(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding: whole parts of the mean are taken off as whole numbers."""
    mean, over = np.divmod(s, n)
    return (x - mean) - over / n


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over dimensions of (n x - S)^2, exact, and whether it fits a long."""
    mean, over = np.divmod(s, n)
    off = x - mean
    rough = (off.astype(float) ** 2).sum(axis=1) * float(n) * n
    small = rough < 2.0**60
    out = np.zeros(len(x), np.int64)
    y = off[small] * n - over
    out[small] = (y * y).sum(axis=1)
    fits = small.copy()
    for i in np.flatnonzero(~small & (rough < 2.0**64)):
        v = sum((int(o) * n - int(m)) ** 2 for o, m in zip(off[i].tolist(), over.tolist(), strict=True))
        if v < 2**63:
            out[i], fits[i] = v, True
    return out, fits


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per kept row of df: row (all its columns), n, deviation, whitened (one value a component), explained and identity_error."""
    rows = _kept(df, column)
    sizes = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    more = [F.lit(None).cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error")]
    if not sizes:
        return df.sparkSession.createDataFrame([], schema).select("*", *more)
    rows = rows.filter(F.size("_v") == sizes[0].d)
    model = fit(rows)
    n, s, k = model["n"], model["s"], min(components, len(model["values"]))
    project = model["vectors"][:, :k] / np.sqrt(model["values"][:k])

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the whitened values and of their products."""
        total = np.zeros((k + 1, k + 1))
        for part in parts:
            y = centre(whole(part), n, s) @ project if len(part) else np.zeros((0, k))
            y = np.column_stack([y, np.ones(len(y))])
            total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    error = 0.0
    if k:
        found = np.zeros((k + 1, k + 1))
        for r in map_batches(rows.select("_v"), spread, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            found[r.i, r.j] = r.v
        mean = found[:k, k] / n
        error = float(np.abs(found[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not len(part):
                continue
            x = whole(part)
            dev, fits = deviations(x, n, s)
            y = centre(x, n, s) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.full(len(x), n)), pa.array(dev, mask=~fits), lists], schema.names)

    share = [float(v) for v in model["values"][:k] / model["trace"]] if k else []
    explained = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    return map_batches(rows, run, schema).select("*", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding, one row a component."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    out = out.select("row.vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
