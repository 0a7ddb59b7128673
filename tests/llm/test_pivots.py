"""Embedding near-duplicates next to all pairs."""

import math

import numpy as np
import pytest

from pulsemill.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links long, kept string"


def brute(rows, limit=0.98):
    """{vec_id: (n_links, component_id, kept)} of rows with different ids, and the linked pairs."""
    good = []
    for v, e, label in rows:
        if (v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e)
                and any(e)):
            good.append((v, np.asarray(e, np.float32).astype(float), label))
    root = {v: v for v, _, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links, pairs = {v: 0 for v, _, _ in rows}, set()
    for label in {g[2] for g in good}:
        for dim in {len(g[1]) for g in good if g[2] == label}:
            own = [g for g in good if g[2] == label and len(g[1]) == dim]
            e = np.stack([g[1] for g in own])
            e /= np.linalg.norm(e, axis=1)[:, None]
            for x, y in zip(*np.nonzero(np.triu(e @ e.T >= limit, 1))):
                a, b = own[x][0], own[y][0]
                pairs.add((a, b))
                links[a] += 1
                links[b] += 1
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return {v: (links[v], find(v), find(v) == v) for v in root}, pairs


def made(rng, n, dim=32):
    x = rng.normal(size=(n, dim))
    rows = [(i, x[i].astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    at = n
    for i in range(0, n, 4):  # near copies around the limit, some of them scaled
        c = rng.uniform(0.975, 0.9999)
        e = rng.normal(size=dim)
        u = x[i] / np.linalg.norm(x[i])
        e -= (e @ u) * u
        y = (c * u + math.sqrt(1 - c * c) * e / np.linalg.norm(e)) * rng.uniform(0.1, 9)
        rows.append((at, y.astype(np.float32).tolist(), rows[i][2]))
        at += 1
    centre = rng.normal(size=dim)
    for _ in range(n // 2):  # a third of all rows is one group, in several texts and copies
        y = centre + (rng.integers(3) > 0) * rng.normal(size=dim) * 0.09
        rows.append((at, y.astype(np.float32).tolist(), 1))
        at += 1
    odd = [[0.0] * dim, [], None, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1),
           [3e38] * dim, [1e-42] * dim, [1.0, 2.0], [1.0, 2.0], [-0.0, 2.0], [0.0, 2.0]]
    for e in odd:
        rows.append((at, e, 2))
        at += 1
    return rows + [(at, x[0].tolist(), None), (at + 1, rows[0][1], (rows[0][2] + 1) % 3)]


@pytest.mark.parametrize("part", [2048, 40])
def test_link_against_all_pairs(spark, part):
    rows = made(np.random.default_rng(3), 400)
    df = spark.createDataFrame([(v, e, label, "x", 1, "y") for v, e, label in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.link(df, part=part).collect()}
    want, _ = brute(rows)
    assert len(got) == len(rows)
    assert all(got[v][0] <= want[v][0] for v in want)  # nothing below the limit
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.995 * there
    assert sum(got[v] == want[v] for v in want) >= 0.99 * len(want)


def test_recall_at_the_limit(spark):
    """Pairs just above the limit, the hardest ones; at least 0.9 is asked for."""
    rng = np.random.default_rng(8)
    n, dim = 3000, 64
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e = rng.normal(size=(n, dim))
    e -= (e * x).sum(1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    y = 0.9801 * x + math.sqrt(1 - 0.9801 ** 2) * e
    rows = [(i, v.tolist(), 0, "", 0, "") for i, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    got = pivots.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_links for r in got) / (2 * n) >= 0.99


def test_repeated_rows_and_no_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "", 0, "")] * 3 + [(2, v, 0, "", 0, ""), (None, v, 0, "", 0, ""), (5, v, 1, "", 0, "")]
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept)
                 for r in pivots.link(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id is not None)
    assert got == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False), (5, 0, 5, True)]


def test_empty(spark):
    assert pivots.link(spark.createDataFrame([], SCHEMA)).count() == 0
