"""The two vector searches against brute force."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from roadpass.llm import ann, exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, n=900, d=20, seed=0, awkward=True):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + 0.3 * rng.standard_normal(d)]) for i in range(n)]
    if awkward:
        # A third of all rows share one vector.
        rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
        rows += [
            (10_000, None), (10_001, []), (10_002, [None] * d), (10_003, [float("nan")] * d), (10_004, [0.0] * d),
            (10_005, [float("inf")] + [0.0] * (d - 1)), (10_006, [1.0]), (None, rows[1][1]), (100, rows[100][1]),
        ]
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(4), rows


def valid(rows, zero):
    out = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 20 and None not in v]
    return [(i, v) for i, v in out if np.isfinite(v).all() and (zero or v.any())]


def ranked(found):
    out = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


@pytest.mark.parametrize("awkward", [False, True])
def test_exact_topk_equals_brute_force(spark, monkeypatch, awkward):
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 200)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    df, rows = frame(spark, awkward=awkward)
    got = ranked(exact_topk.exact_topk(df).collect())
    items = [(i, np.floor(256 * v).astype(np.int64)) for i, v in valid(rows, zero=True)]
    want = {}
    for i, v in items:
        if i % 50 == 0:
            scored = sorted(((j, int(v @ w)) for j, w in items if j != i), key=lambda x: (-x[1], x[0]))
            want[i] = scored[:5]
    assert got == want


def test_statistics_bound_the_product():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (40, 22)), rng.integers(-300, 300, (50, 22))
    for length in exact_topk.SEGMENTS:
        bound = exact_topk.statistics(a, length) @ exact_topk.statistics(b, length).T
        assert (bound + 1e-6 * np.abs(bound) >= a @ b.T).all()


def test_exact_topk_gives_all_when_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [2.0, 2.0], 1), (3, [2.0, 2.0], 1)], SCHEMA)
    assert ranked(exact_topk.exact_topk(df).collect()) == {0: [(3, 393216), (7, 393216)]}


@pytest.mark.parametrize("awkward", [False, True])
def test_ann_recall_scores_and_order(spark, awkward):
    df, rows = frame(spark, n=1500, awkward=awkward)
    got = ranked(ann.nearest(df).collect())
    items = valid(rows, zero=False)
    hit = total = 0
    for i, v in items:
        if i % 20 == 0:
            score = {j: float(v @ w) for j, w in items if j != i}
            best = sorted(score.values(), reverse=True)[:20]
            assert len(got[i]) == 20
            assert all(s == pytest.approx(score[j], abs=1e-12) for j, s in got[i])
            assert got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
            hit += sum(s >= best[-1] - 1e-12 for _, s in got[i])
            total += 20
    assert hit / total >= 0.9


def test_ann_gives_all_when_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [2.0, 2.0], 1), (3, [2.0, 2.0], 1), (5, [0.0, 0.0], 1)], SCHEMA)
    assert ranked(ann.nearest(df).collect()) == {0: [(3, 6.0), (7, 6.0)]}


@pytest.mark.parametrize("copies", [200, 990])
def test_ann_of_a_much_repeated_query_id(spark, copies):
    """Rows of the query's own id crowd the sample's nearest; the query still gets its k rows."""
    rng = np.random.default_rng(4)
    first = rng.standard_normal(16)
    rows = [(100, (first + 1e-3 * rng.standard_normal(16)).tolist(), 1) for _ in range(copies)]
    rows += [(1001 + i, rng.standard_normal(16).tolist(), 1) for i in range(1000 - copies)]
    got = ranked(ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    asking = {i for i, _, _ in rows if i % 20 == 0}
    assert set(got) == asking and all(len(got[i]) == min(20, sum(j != i for j, _, _ in rows)) for i in asking)
    assert 100 not in {j for j, _ in got[100]}


def test_ann_recall_beyond_the_sample(spark, monkeypatch):
    """The index is fitted on a part of the rows; k-means and limits must still hold for the rest."""
    monkeypatch.setattr(ann, "SAMPLE", 400)
    df, rows = frame(spark, n=4000, awkward=False)
    got = ranked(ann.nearest(df).collect())
    vectors = np.array([v for _, v in rows])
    hit = 0
    for i in got:
        score = vectors @ vectors[i]
        score[i] = -np.inf
        hit += sum(s >= np.sort(score)[-20] - 1e-9 for _, s in got[i])
    assert len(got) == 200 and hit / (20 * len(got)) >= 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk.exact_topk(none).count() == 0
    assert ann.nearest(none).count() == 0
