"""Operators on embeddings against brute force."""

import math

import numpy as np
import pytest

from cinelake.llm import ann, embedding_dedup
from cinelake.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, times int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    for k in range(100, 300):
        x[k] = x[rng.integers(0, 40)] * rng.uniform(0.5, 2) + rng.normal(size=24) * rng.choice([0, 0.1, 0.3])
    rows = [(k, v.tolist(), 0, 0, "", 0) for k, v in enumerate(x)]
    rows += [(700, None, None, None, None, None), (701, [], 0, 0, "", 0), (702, [0.0] * 24, 0, 0, "", 0), (703, [None] + [1.0] * 23, 0, 0, "", 0), (704, [math.nan] + [1.0] * 23, 0, 0, "", 0), (705, [math.inf] * 24, 0, 0, "", 0), (5, x[5].tolist(), 1, 1, "", 1), (None, x[7].tolist(), 1, 1, "", 1)]
    return spark.createDataFrame(rows, SCHEMA), np.vstack([x, x[7]]).astype(np.float64), [*range(600), 2**63 - 1]


def test_embedding_dedup(table):
    df, x, ids = table
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[k], root[near[k]].min(initial=len(x))) for k in range(len(x))])
        if (new == root).all():
            break
        root = new
    found = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(found) == 607
    for k, name in enumerate(ids):
        assert found[name] == (int(near[k].sum()), ids[root[k]], name == ids[root[k]])
    assert all(found[k] == (0, k, True) for k in range(700, 706))
    assert near.sum() > 100


def test_blocks_cut_full_cells(table, monkeypatch):
    df, _, _ = table
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "PIECE", 7)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == whole


def test_dedup_of_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search(table):
    df, x, ids = table
    rows = usable(df)
    found = ann.search(rows, rows.where("id % 20 = 0"), k=20)
    assert ann.recall(found, rows, rows.where("id % 20 = 0")) >= 0.9
    by_query = {}
    for r in found.collect():
        by_query.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    assert set(by_query) == set(range(0, 600, 20))
    for query, own in by_query.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and query not in {i for _, i, _ in own}
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        assert all(s == pytest.approx(float(x[ids.index(i)] @ x[query]), abs=1e-9) for _, i, s in own)


def test_search_in_few_rows(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(0, 60, 20)], "vec_id long, embedding array<double>")
    rows = usable(df)
    assert sorted(map(tuple, ann.search(rows, rows).collect())) == [(0, 1, 20, 1.0), (0, 2, 40, 1.0), (20, 1, 40, 801.0), (20, 2, 0, 1.0), (40, 1, 20, 801.0), (40, 2, 0, 1.0)]
    nothing = usable(spark.createDataFrame([], SCHEMA))
    assert ann.search(nothing, nothing).count() == 0


def test_clustered_vectors_need_few_partitions():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.5
    index = ann.fit(x, 20)
    parts = index.layers[-1].shape[0]
    assert index.recall >= 0.9 and 2 * index.probes < parts


def test_queries_go_on_until_they_have_enough(spark):
    """Tiny clusters: the partitions that a query would look in hold fewer rows than it wants."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    rows = usable(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, [1.0, float(k)]) for k in range(5)], "vec_id long, embedding array<double>"))
    index = ann.fit(x, 20, recall=0.0)
    assert index.probes == 1 and index.layers[-1].shape[0] > 1
    found = ann._search(rows.where("id < 1000"), rows.where("id < 1000"), 100, index)
    assert {r["count"] for r in found.groupBy("query").count().collect()} == {100}
    both = {r["query"]: r["count"] for r in ann.search(rows, rows.where("id >= 1000 or id < 3"), 20).groupBy("query").count().collect()}
    assert both == {**dict.fromkeys(range(3), 20), **dict.fromkeys(range(1000, 1005), 4)}


def test_partitions_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 8)) + 6 * np.eye(8)[rng.integers(0, 8, 800)]
    part = ann.balanced(x, ann._nearest(x, x, 8, True), 8)
    assert np.bincount(part, minlength=8).max() <= 101
