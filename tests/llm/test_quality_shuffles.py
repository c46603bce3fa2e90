"""Operator 7 sends every text through one shuffle at most, whatever the size of the labels."""

from quayside.llm import quality


def test_texts_meet_labels_once(spark, monkeypatch):
    plans = {}
    kept = quality.written

    def record(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(quality, "written", record)
    docs = spark.createDataFrame([(i, f"w{i % 3} common words of a text that has ten words or more w{i}") for i in range(40)] + [(3, None), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    for threshold in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = quality.quality_rules(docs, labels)
            assert got.count() == 42 and got.where("kept").count() > 0
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # the same plan at every size: one merge join of the texts for the ratios, none for the scores
        assert plans["quality-counts"].count("SortMergeJoin") == 1
        assert "SortMergeJoin" not in plans["quality-scores"] and "fit_label" not in plans["quality-scores"]
