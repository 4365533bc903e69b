import random
from collections import defaultdict

import numpy as np
from factloom.llm.packing import fill, fullest, pack

WINDOWS = "window_id bigint, kind string, codes array<int>, prompt_len int, capacity int"


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 60)
        lengths, counts = np.unique(sizes, return_counts=True)
        got = sum(int(lengths[::-1][i]) * c for i, c in fullest(lengths[::-1], counts[::-1].copy(), room))
        reach = {0}
        for s in sizes:
            reach |= {x + s for x in reach if x + s <= room}
        assert got == max(reach)


def test_fill_keeps_capacity():
    rng = random.Random(3)
    sizes = np.asarray([rng.randint(0, 100) for _ in range(500)])
    bins = fill(sizes, 100)
    assert (bins >= 0).all() and np.bincount(bins, weights=sizes).max() <= 100
    assert bins.max() + 1 <= 1.04 * max(-(-sizes.sum() // 100), (sizes > 50).sum())


def test_windows_whole_cut_null_and_repeated(spark):
    rng = random.Random(4)
    rows = [(i, "qa", [1] * rng.randint(0, 90), rng.choice([None, 0, 5, 500, -3]), 0) for i in range(300)]
    rows += [(1000, "qa", None, None, 0), (1001, "qa", [1] * 250, 120, 0), (1001, "qa", [1] * 40, 10, 0), (1002, "other", [1, 2], 1, 0), (1003, None, [1], 0, 0), (None, "qa", [1], 0, 0)]
    df = spark.createDataFrame(rows, WINDOWS)
    targets = spark.createDataFrame([("qa", 100)], "kind string, capacity int")
    out = pack(df, targets, block=64).collect()
    used, got = defaultdict(int), defaultdict(list)
    for r in out:
        if r.container is not None:
            used[r.container] += r.n
        got[r.window_id].append(r)
    assert max(used.values()) <= 100 and len(used) <= -(-sum(used.values()) // 100) + 3
    for i, _, codes, _, _ in rows[:300]:
        assert [r.n for r in got[i]] == [len(codes)]
    cut = sorted(got[1001], key=lambda r: (r.piece, -r.n))
    assert sorted(r.n for r in cut) == [40, 50, 100, 100]
    assert sum(r.prompt_n for r in cut if r.n != 40) == 120
    assert got[None][0].container is None and got[1002][0].container is None and got[1003][0].container is None
    for r in out:
        if r.prompt_n is not None:
            assert 0 <= r.prompt_n <= r.n
    spots = defaultdict(list)
    for r in out:
        if r.container and r.n:
            spots[r.container].append((r.at, r.at + r.n))
    assert all(a[1] <= b[0] for s in spots.values() for a, b in zip(sorted(s), sorted(s)[1:]))


def test_empty_tables(spark):
    targets = spark.createDataFrame([], "kind string, capacity int")
    assert pack(spark.createDataFrame([], WINDOWS), targets).count() == 0
    assert pack(spark.createDataFrame([(1, "qa", [1], 0, 0)], WINDOWS), targets).first().container is None
