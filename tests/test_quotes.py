"""Quotes of any form are found wherever contains() finds them."""

from evidentia import plans

TEXTS = ["He said: \"The old bank of the river has many trees\", and left.", "one two three four five six seven", "one two three", "  lead one\ttwo  three four five six ", "", None, "bank (of the river) has many trees, too"]
QUOTES = ["The old bank of the river has many trees", "two", "one two three", "wo three four", "two three four five", "ne two three four five six sev", "river has many trees", "", None, " one\ttwo  three four five six ", "of the river) has many trees", "nowhere at all in any of these texts"]


def test_quotes(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.quote_id: r.n_documents for r in plans.QUERIES["quote_verbatim"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(q is not None and t is not None and q in t for t in TEXTS) for i, q in enumerate(QUOTES)}
