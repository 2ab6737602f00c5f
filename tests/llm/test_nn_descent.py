import numpy as np
import pytest

from timberline.llm import nn_descent
from timberline.llm.common import Scratch
from timberline.llm.nn_descent import near_duplicates


def plain(rows, threshold):
    width = max((len(v) for _, v in rows if v is not None), default=0)
    units = []
    for _, v in rows:
        ok = v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)
        u = np.zeros(width)
        if ok:
            u[: len(v)] = np.array(v) / np.abs(v).max()
            u /= np.sqrt(u @ u)
        units.append((ok, u))
    valid = np.array([ok for ok, _ in units])
    m = np.array([u for _, u in units]).reshape(len(rows), -1)
    linked = (m @ m.T >= threshold) & valid[:, None] & valid[None, :]
    np.fill_diagonal(linked, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked)):
        root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least.setdefault(find(i), []).append(id_)
    known = {k: min([x for x in v if x is not None], default=None) for k, v in least.items()}
    return [(id_, int(linked[i].sum()), known[find(i)], id_ == known[find(i)]) for i, (id_, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, mark string")


def result(spark, rows, **kw):
    return [tuple(r) for r in near_duplicates(frame(spark, rows).repartition(3), Scratch(spark), **kw).collect()]


ORDER = {"key": lambda r: tuple((x is None, x or 0) for x in r)}


@pytest.mark.parametrize("block", [7, 512])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    rows = [(k, v) for k, v in enumerate(base)]
    for k in range(120):
        rows.append((100 + k, base[k % 5] + r.standard_normal(16) * 0.05 * (k % 8)))
    rows += [(500 + k, base[7]) for k in range(9)] + [(600 + k, base[7] * 3) for k in range(3)]
    rows = [(k, np.float32(v).tolist()) for k, v in rows]
    got, want = result(spark, rows), plain([(k, np.float64(v)) for k, v in rows], 0.9)
    assert sorted(got) == sorted((k, int(n), c, kept) for k, n, c, kept in want)


def test_all_pairs_where_the_longest_lists_fail(spark, monkeypatch):
    for name, value in {"NEIGHBOURS": 2, "MOST_NEIGHBOURS": 2, "ORDERS": 1, "WIDTH": 1, "ROUNDS": 1, "BLOCK": 50}.items():
        monkeypatch.setattr(nn_descent, name, value)
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 24))
    near = base + r.standard_normal(base.shape) * 0.2
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(np.concatenate([base, near]))]
    got, want = result(spark, rows), plain([(k, np.float64(v)) for k, v in rows], 0.9)
    assert sorted(got) == sorted((k, int(n), c, kept) for k, n, c, kept in want)


def test_audit_sees_pairs_beside_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 50)
    r = np.random.default_rng(6)
    large = r.standard_normal(32) + r.standard_normal((400, 32)) * 0.05
    pairs = np.repeat(r.standard_normal((20, 32)), 2, axis=0) + r.standard_normal((40, 32)) * 0.02
    units = np.concatenate([large, pairs])
    units /= np.sqrt((units * units).sum(axis=1, keepdims=True))
    nodes = spark.createDataFrame([(k, u.tobytes(), 1) for k, u in enumerate(units)], "node long, unit binary, rows long")
    roots = spark.createDataFrame([(k, 0) for k in range(400)], "node long, root long")
    # All links of the large component are known, none of the pairs.
    counted = nn_descent._counts(nodes, roots, 0.9)
    assert nn_descent._recall(nodes, roots, counted, 0.9, 200) < 0.5
    whole = roots.unionAll(spark.createDataFrame([(400 + k, 400 + k // 2 * 2) for k in range(40)], "node long, root long"))
    assert nn_descent._recall(nodes, whole, nn_descent._counts(nodes, whole, 0.9), 0.9, 200) == 1.0


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []),
        (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [3.0]), (None, [5.0, 0.0]), (None, [0.0, 1.0]), (10, [-1.0, 0.0]), (11, [1e-30, 1e-38]), (12, [1.0, 0.0, 0.1]),
    ]
    out = {}
    for id_, n, component, kept in result(spark, rows):
        out.setdefault(id_, []).append((n, component, kept))
    assert out[1] == [(6, 1, True)] and out[8] == [(6, 1, False)] * 2 and out[9] == [(6, 1, False)]
    assert sorted(out[None], key=str) == [(0, None, True), (6, 1, False)]
    assert all(out[k] == [(0, k, True)] for k in (2, 3, 4, 5, 6, 7, 10))
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 1, True)]
