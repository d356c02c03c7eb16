"""Thresholds of drift against a plain version over the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import drift_null as N


def plain(rows, order, names, window, bins=10):
    """Worst PSI of one round: rows are (group, values), order its groups."""
    size, held, count = {}, {}, 0
    for g, *_ in rows:
        size[g] = size.get(g, 0) + 1
    for g in order:
        if count >= window:
            break
        held[g] = min(1.0, (window - count) / size[g])
        count += size[g]
    rest = [r for r in rows if r[0] not in held]
    if count < window or len(rest) < max(30, window // 2):
        return None
    worst = None
    for q in range(1, len(names) + 1):
        v = sorted(r[q] for r in rest if r[q] is not None)
        own = [(r[q], held[r[0]]) for r in rows if r[0] in held and r[q] is not None]
        if not v or not own:
            continue
        edges = set()
        for k in range(1, bins):
            lo, more = divmod((len(v) - 1) * k, bins)
            edges.add(v[lo] if not more or v[lo] == v[lo + 1] else v[lo] + more / bins * (v[lo + 1] - v[lo]))
        edges = sorted(edges)
        e, a = np.zeros(len(edges) + 1), np.zeros(len(edges) + 1)
        for x in v:
            e[np.searchsorted(edges, x, side="right")] += 1
        for x, w in own:
            a[np.searchsorted(edges, x, side="right")] += w
        e, a = np.maximum(e / e.sum(), 1e-4), np.maximum(a / a.sum(), 1e-4)
        e, a = e / e.sum(), a / a.sum()
        found = float(((a - e) * np.log(a / e)).sum())
        worst = found if worst is None else max(worst, found)
    return worst


def made(n, groups, seed, hot=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = None if i % 97 == 5 else "hot" if hot and i % 3 == 0 else f"g{rng.integers(groups)}"
        own = 0.3 * (hash_of(g) % 7)
        rows.append((i, g, float(rng.normal(own)), float(rng.integers(3)), None if i % 11 == 0 else float(np.round(rng.exponential(), 1)), 1.0 if i == 7 else 0.0))
    return rows


def hash_of(g):
    return sum(map(ord, g or ""))


@pytest.mark.parametrize("n, groups, window, hot", [(600, 60, 120, False), (600, 200, 97, False), (500, 30, 100, True), (300, 5, 90, False)])
def test_rounds_equal_a_plain_version(spark, n, groups, window, hot):
    rows, names, rounds = made(n, groups, n + groups, hot), ("a", "b", "c", "d"), 25
    df = spark.createDataFrame(rows, "decision_id long, grp string, a double, b double, c double, d double").repartition(3)
    keyed = [(f"group:{g}" if g is not None else f"row:{i}", *v) for i, g, *v in rows]
    names_of = sorted({r[0] for r in keyed})
    drawn = spark.createDataFrame([(k, g) for k in range(1, rounds + 1) for g in names_of], "round int, g string").select("round", "g", F.xxhash64(F.lit(3), "round", "g").alias("h")).collect()
    orders: dict = {}
    for r in sorted(drawn, key=lambda r: (r.round, r.h % N.CLASSES, r.h, r.g)):
        orders.setdefault(r.round, []).append(r.g)
    want = {k: w for k in orders if (w := plain(keyed, orders[k], names, window)) is not None}
    got = {r.round: r.worst for r in N.worst_psi(df, "grp", names, window, rounds, 3).collect()}
    assert set(got) == set(want) and (want or groups < 10)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_thresholds_and_the_fallback(spark):
    rows = made(600, 60, 1)
    df = spark.createDataFrame(rows, "decision_id long, grp string, a double, b double, c double, d double")
    x = N.null_thresholds(df, "grp", ("a", "b"), 100, rounds=40).first()
    worst = [r.worst for r in N.worst_psi(df, "grp", ("a", "b"), 100, rounds=40).collect()]
    assert x.calibrated and x.rounds == len(worst) and x.moderate == round(max(0.1, float(np.quantile(worst, 0.95))), 4) and x.significant == round(max(0.25, float(np.quantile(worst, 0.99))), 4)
    for few in (df.limit(20), df.limit(0)):
        r = N.null_thresholds(few, "grp", ("a", "b"), 100, rounds=30).first()
        assert (r.moderate, r.significant, r.null_median, r.rounds, r.calibrated) == (0.1, 0.25, None, 0, False)
