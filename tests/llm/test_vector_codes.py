"""Vector codes against plain integer k-means."""
import hashlib
import math
import random

import numpy as np
import pytest

from placewise.llm import vector_codes

LONG_MAX = (1 << 63) - 1


def _plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = max(1, -(-len(kept[0][2]) // parts))
    cut = [[(v + [0] * (w * parts))[p * w:(p + 1) * w] for _, _, v in kept] for p in range(parts)]
    first = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2]))[:entries]
    books = [[cut[p][k] for k in first] or [[0] * w] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(p, v)[1] for v in cut[p]]
            for j in set(got):
                mine = [v for v, g in zip(cut[p], got) if g == j]
                books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    last = [[near(p, cut[p][k]) for p in range(parts)] for k in range(len(kept))]
    error = [min(sum(d for d, _ in r), LONG_MAX) for r in last]
    total = {}
    for (_, lab, _), e in zip(kept, error):
        total[lab] = min(total.get(lab, 0) + e, LONG_MAX)
    return sorted((i, "".join(f"{j:02x}" for _, j in r), e, total[lab], digest) for (i, lab, _), r, e in zip(kept, last, error) if i is not None)


def _got(spark, rows, **more):
    df = vector_codes.compress(spark.createDataFrame([(i, v, lab, "x", 3) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string, u int"), **more)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect() if r.vec_id is not None))


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13, 1e30])     # doubles, 64-bit, Python integers
def test_equals_plain_version(spark, scale):
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0, scale), 3) for _ in range(10)], rng.choice([None, 1, 2])) for i in range(420)]
    rows += [(500 + i, rows[3][1], 1) for i in range(300)]                                                      # a very common vector
    rows += [(3, rows[3][1], 1), (1000, None, 1), (1001, [None] * 10, 1), (1002, [float("nan")] * 10, 1), (1003, [float("inf")] * 10, None)]
    assert _got(spark, rows, entries=20) == _plain(rows, entries=20)


def test_ids_missing_and_ties(spark):
    rows = [(i, [float(i % 2), 0.0, 1.0, 1.0], None) for i in range(9)]
    assert _got(spark, rows) == _plain(rows)                                                                    # equal entries: the lower index
    assert len(vector_codes.compress(spark.createDataFrame([(None, [1.0], 1)], "vec_id long, embedding array<double>, label int")).collect()) == 1


def test_one_length_and_empty(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0), (3, [1.0], 0), (4, [], 0)]
    assert [r[0] for r in _got(spark, rows)] == [1, 2]
    assert _got(spark, []) == []
    assert [r[:3] for r in _got(spark, [(1, [], None)])] == [(1, "00000000", 0)]


def test_shortlists_keep_the_nearest_entry():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, book = np.floor(rng.normal(0, 9, (30, 3))), np.floor(rng.normal(0, 12, (40, 3)))
        listed = vector_codes.shortlist(x.min(0), x.max(0), book)
        best, d = vector_codes.nearest(x, book[listed])
        best_all, d_all = vector_codes.nearest(x, book)
        assert (listed[best] == best_all).all() and (d == d_all).all()


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = grid[np.argsort(np.array([int.from_bytes(k, "big") for k in vector_codes.hilbert_keys(grid, 3)]))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
