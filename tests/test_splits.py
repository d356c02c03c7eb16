"""Splits by quota against plain greedy loops."""

import hashlib
import random

import pytest

from mailsift.operators import splits as S


def made(groups, seed, sizes):
    r, rows, i = random.Random(seed), [], 0
    for g in range(groups):
        own = r.random()
        for _ in range(r.choice(sizes)):
            rows.append((i, f"g{g}", None if own < 0.1 else int(r.random() < own), "extra"))
            i += 1
    rows += [(i + k, None, k % 2, "extra") for k in range(5)]
    r.shuffle(rows)
    return rows


def grouped(rows, seed):
    out = {}
    for i, g, y, _ in rows:
        g = f"group:{g}" if g is not None else f"row:{i}"
        out.setdefault(hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), []).append((i, y))
    return dict(sorted(out.items()))


@pytest.mark.parametrize("groups, sizes, share", [(1000, [1, 1, 2, 3, 40], 0.25), (60, [1, 5, 80, 200], 0.3), (3, [50], 0.25), (40, [2], 1.0)])
def test_quota_split_equals_a_greedy_loop(spark, groups, sizes, share):
    rows = made(groups, groups, sizes)
    by_class: dict = {}
    for k, members in grouped(rows, "split").items():
        ys = [y for _, y in members if y is not None]
        by_class.setdefault(-1 if not ys else int(2 * sum(ys) >= len(ys)), []).append((k, members))
    want = {}
    for own in by_class.values():
        quota, taken = int(2 * share * sum(len(m) for _, m in own)), 0
        for _, members in own:
            fits = 2 * taken + len(members) <= quota
            taken += len(members) * fits
            want.update({i: "test" if fits else "train" for i, _ in members})
    df = spark.createDataFrame(rows, "message_id long, grp string, y int, n string").repartition(3)
    got = S.quota_split(df, "grp", "y", share).collect()
    assert len(got) == len(rows) and {r.message_id: r.part for r in got} == want and set(got[0].asDict()) == {"message_id", "grp", "y", "n", "part"}


def test_pools_equal_a_loop(spark):
    rows = made(300, 9, [1, 2, 30])
    df = spark.createDataFrame(rows, "message_id long, grp string, y int, n string").repartition(3)
    for targets in ({"cal": 200, "stack": 150}, {"cal": 10**6, "stack": 5}, {"cal": 0, "stack": 1}):
        held, want = dict.fromkeys(targets, 0), {}
        for members in grouped(rows, "pools").values():
            pool = next((p for p, t in targets.items() if held[p] < t), "fit")
            if pool in held:
                held[pool] += len(members)
            want.update({i: pool for i, _ in members})
        assert {r.message_id: r.pool for r in S.filled_pools(df, "grp", targets).collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "message_id long, grp string, y int")
    assert S.quota_split(none, "grp", "y").count() == 0 and S.filled_pools(none, "grp", {"cal": 3}).count() == 0
