"""Every labelled row counts in the fit of operator 7."""

from quayside.llm import quality


def test_all_labelled_rows_are_fit_rows(spark):
    labels = spark.range(45_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    fit = quality._fit_rows(labels.unionByName(spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id long, quality int")))
    counts = {r["fit_label"]: r["count"] for r in fit.groupBy("fit_label").count().collect()}
    assert counts == {0: 22_501, 1: 22_499}
