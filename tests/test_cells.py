"""Cells with bounds, and the index of a session, against a search over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.config import RetrievalConfig
from foliant.operators import cells, retrieval
from foliant.operators.session_index import index_cells, index_top_k, session_index
from foliant.runtime import names_below

DIM = 12


def clustered(spark, n, seed, groups=8, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM))
    rows = [(i, [float(x) for x in centres[i % groups] + spread * rng.normal(size=DIM)]) for i in range(n)]
    rows += [(n, [0.0] * DIM), (n + 1, None), (n + 2, []), (n + 3, rows[0][1]), (n + 4, rows[0][1])]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def as_queries(df):
    return df.filter("id % 37 = 0 OR size(embedding) = 0").select(F.col("id").alias("query_id"), "embedding")


def listed(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
@pytest.mark.parametrize("spread,k,threshold", [(0.15, 5, None), (1.5, 7, None), (0.3, 400, 2.0)])
def test_v5_cells_with_bounds_equal_the_flat_search(spark, tmp_path, metric, spread, k, threshold):
    corpus = clustered(spark, 400, 3, spread=spread).persist()
    config, path = RetrievalConfig(metric=metric, nlist=9, nprobe=1), str(tmp_path / "cells")
    cells.write_bounded_cells(corpus, path, config=config)
    asked = as_queries(corpus)
    near = cells.exact_cell_top_k(asked, path, k=k, threshold=threshold, config=config)
    assert listed(near) == listed(retrieval.top_k(asked, corpus, k=k, threshold=threshold, config=config))


def test_v5_parts_that_cannot_hold_a_better_row_are_not_read(spark, tmp_path, monkeypatch):
    corpus = clustered(spark, 2000, 5, groups=20, spread=0.05).persist()
    config, path = RetrievalConfig(nlist=30, nprobe=2), str(tmp_path / "cells")
    cells.write_bounded_cells(corpus, path, config=config)
    asked = as_queries(corpus).filter("query_id = 37")
    plans, search = [], cells.top_k

    def watched(queries, stored, **options):
        found = search(queries, stored, **options)
        plans.append((found._jdf.queryExecution().executedPlan().toString(),
                      {p for r in queries.select("probes").collect() for p in r.probes}))
        return found

    monkeypatch.setattr(cells, "top_k", watched)
    near = cells.exact_cell_top_k(asked, path, config=config)
    assert listed(near) == listed(retrieval.top_k(asked, corpus, config=config))
    parts = sum(len(names_below(spark, f"{path}/cells/{c}"))
                for c in names_below(spark, f"{path}/cells") if c.startswith("cell="))
    read = set().union(*(probes for _, probes in plans))
    assert len(read) < parts / 2
    assert all("PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1]
               for plan, _ in plans)


@pytest.mark.parametrize("metric,threshold", [("inner_product", 6.0), ("l2", 1.5), ("l2", 30.0)])
def test_j5_all_pairs_above_a_threshold(spark, tmp_path, metric, threshold):
    corpus = clustered(spark, 300, 7).persist()
    config, path = RetrievalConfig(metric=metric, nlist=9), str(tmp_path / "cells")
    cells.write_bounded_cells(corpus, path, config=config)
    found = cells.pairs_above(as_queries(corpus), path, threshold, config=config)
    every = retrieval.matches(as_queries(corpus), corpus, threshold=threshold, config=config)
    pairs = sorted(map(tuple, every.collect()))
    assert pairs and sorted(map(tuple, found.collect())) == pairs


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(500, DIM)), rng.normal(size=(30, DIM))
    directions = cells._directions(rng.normal(size=(4, DIM)))
    part = rng.integers(0, 6, 500)
    of = np.array([0, 0, 1, 2, 3, 3])
    along, across = cells._split(rows, directions[of[part]])
    ranges = [np.array([f(x[part == p]) for p in range(6)])
              for x, f in ((along, np.min), (along, np.max), (across, np.min), (across, np.max))]
    for metric, keys in (("inner_product", -(queries @ rows.T)),
                         ("l2", ((queries[:, None] - rows[None]) ** 2).sum(axis=2))):
        bound = cells.best_keys(queries, directions, of, ranges, metric)
        assert (keys >= bound[:, part]).all()


def session_rows(spark, n=240):
    corpus = clustered(spark, n, 11)
    return corpus.filter("id < 240 OR size(embedding) = 0 OR embedding IS NULL").select(
        F.when(F.col("id") % 5 == 0, "small").when(F.col("id") < 3, "tiny").otherwise("large")
        .alias("session"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "embedding")


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
def test_k7_search_in_a_session_index(spark, metric):
    rows, config = session_rows(spark).persist(), RetrievalConfig(metric=metric, nlist=7, nprobe=2)
    index = session_index(rows, config, rows_per_group=50).persist()
    usable = rows.filter(F.size("embedding") > 0)
    assert index.count() == usable.count()
    shape = {(r.session, r.cell): r for r in index_cells(index).collect()}
    assert {s: sum(1 for t, _ in shape if t == s) for s in ("large", "small", "tiny")} == {
        "large": 7, "small": 7, "tiny": 2}
    assert index.filter("centre").count() == 16
    asked = usable.filter("id IN ('c1', 'c2', 'c5', 'c6', 'c77', 'c100')").select(
        F.col("id").alias("query_id"), "session", "embedding")
    found = listed(index_top_k(asked, index, k=4, config=config))
    want = []
    for session in ("large", "small", "tiny"):
        want += listed(retrieval.top_k(
            asked.filter(F.col("session") == session), usable.filter(F.col("session") == session),
            k=4, config=config))
    assert found == sorted(want)
