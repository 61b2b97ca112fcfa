"""The index against the exact scan: recall, pruned lists, all rows indexed."""

import numpy as np
import pytest

from evidentia.operators.scan_search import dense_scan
from evidentia.operators.vector_index import VectorIndex, k_means
from evidentia.sources.views import Tables


def recall(found, exact):
    a, b = ({(r.query_id, r.chunk_id) for r in x.collect()} for x in (found, exact))
    return len(a & b) / len(b)


def planted(spark, n=4000, dim=24, seed=5):
    g = np.random.Generator(np.random.PCG64(seed))
    middles = g.normal(size=(60, dim))
    v = middles[g.integers(0, 60, n)] + 0.35 * g.normal(size=(n, dim))
    v[: n // 3] = middles[0] + 0.2 * g.normal(size=(n // 3, dim))  # a third of all vectors in one place
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0])]
    return spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(4).cache()


def test_recall_and_pruning(spark, tmp_path):
    v = planted(spark)
    index = VectorIndex.build(v, f"file://{tmp_path}/index")
    assert index.rows().count() == 4000 and len(index.centres) == 63
    q = v.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "vector AS query_vector")
    assert recall(index.search(q, v, 10), dense_scan(q, v, 10)) >= 0.95
    one = q.filter("query_id = 3980")
    plan = index.candidates(one.collect(), 10, 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    lists = index.probed(np.array([one.first().query_vector]), 4)
    assert lists.shape == (1, 4) and index.rows(sorted(lists[0].tolist())).count() < 4000
    assert VectorIndex(spark, index.path).search(one, v, 5).count() == 5
    v.unpersist()


def test_recall_on_the_given_vectors(spark, tmp_path):
    v = Tables(spark, "/root/testdata/sf0.01").vectors().select("chunk_id", "vector")
    q = v.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "vector AS query_vector")
    index = VectorIndex.build(v, f"file://{tmp_path}/index")
    assert recall(index.search(q, v, 20), dense_scan(q, v, 20)) >= 0.95


def test_k_means_of_few_rows(spark, tmp_path):
    assert len(k_means(np.ones((5, 3)), 4)) == 1
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([], "chunk_id long, vector array<double>"), f"file://{tmp_path}/none")
