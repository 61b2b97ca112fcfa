"""Cases of the fourth round's findings."""

import pytest

from tests.test_findings_r03 import agree  # noqa: F401


@pytest.mark.parametrize("name", ["hallucination_rate", "quote_audit_rows", "eval_triples"])
def test_every_item_is_looked_for_as_it_stands(agree, name):  # noqa: F811
    """Item 1 stands in the documents; it was asked for backwards only."""
    got = agree(name, benchmark="SELECT * FROM (VALUES (1::BIGINT, 'of the and'), (3, '?? !!')) v(item_id, text)", documents="SELECT i AS doc_id, 'one of the and two' AS text, 'en' AS lang, 's' AS source, 18::BIGINT AS n_chars FROM range(1, 9) r(i) UNION ALL SELECT 82, 'x', 'en', 's', 1", embeddings="SELECT * FROM src_embeddings WHERE vec_id > 100")
    hallucinated = [("hallucination_detected", '{"quote":"?? !!"}', "3"), ("hallucination_detected", '{"quote":"dna eht fo"}', "-2")]
    if name == "eval_triples":
        assert len(got) == 9
    else:
        assert got == {"hallucination_rate": [("3", "0.666667")], "quote_audit_rows": sorted(hallucinated)}[name]


def test_blocks_of_an_indexed_search_are_bounded(spark, tmp_path, monkeypatch):
    """blocks count the candidates that a worker holds; a task's closure has the queries' vectors, not tables of them."""
    from pyspark import cloudpickle

    from evidentia.operators import scan_search as S
    from evidentia.operators.vector_index import VectorIndex
    from tests.test_vector_index import planted, recall

    v = planted(spark)
    q = v.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "vector AS query_vector")
    index = VectorIndex.build(v, f"file://{tmp_path}/index")
    sent, map_in_arrow = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, *a: sent.append(len(cloudpickle.dumps(f))) or map_in_arrow(self, f, *a))
    whole = index.search(q, v, 10)
    assert len(sent) == 1 and sent[0] < 400_000  # 200 queries by 8 * 256 code words were 3.3 MB
    monkeypatch.setattr(S, "QUERY_BYTES", 1 << 20)
    parts = index.search(q, v, 10)
    assert len(sent) > 2
    rows = lambda df: {(r.query_id, r.chunk_id, r.rank) for r in df.collect()}
    assert rows(parts) == rows(whole) and recall(whole, S.dense_scan(q, v, 10)) >= 0.95
    v.unpersist()


def test_texts_are_split_once_for_all_blocks(spark, monkeypatch):
    """further blocks of queries read the tokens that were written once, and one window takes the best of all."""
    from evidentia.operators import scan_search as S
    from tests.test_scan_search import texts

    df = spark.createDataFrame(texts(300), "chunk_id long, content string").repartition(3)
    q = df.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "content AS text")
    rows = lambda x: {(r.query_id, r.chunk_id, r.score, r.rank) for r in x.collect()}
    one = S.sparse_scan(q, df, 5)
    monkeypatch.setattr(S, "QUERY_BYTES", 60_000)
    monkeypatch.setattr(S, "TILE_POSTINGS", 300)
    more = S.sparse_scan(q, df, 5)
    plan = more._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 3 and "regexp" not in plan and plan.count("Window [") == 1 and "regexp" in one._jdf.queryExecution().optimizedPlan().toString()
    assert rows(more) == rows(one)
