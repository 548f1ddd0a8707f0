"""Representative-document sampling and label mapping, on the reference's literal cases."""

import pytest
from pyspark.sql import functions as F

from topicspark.operators import labels as L
from topicspark.operators import metadata as M
from topicspark.operators import sample as X
from topicspark.sources import files as S


def strata_docs(spark):
    rows = [(0, "d0", 0, "A", 0.9, 0.1), (1, "d1", 0, "A", 0.8, 0.2), (2, "d2", 0, "B", 0.1, 0.9),
            (3, "d3", 1, "A", 0.4, 0.6), (4, "d4", 1, "B", 0.2, 0.8), (5, "d5", 1, "B", 0.1, 0.9)]
    df = spark.createDataFrame(rows, "docid long, text string, topic int, genre string, p0 double, p1 double")
    return df.withColumn("w", F.when(F.col("topic") == 0, F.col("p0")).otherwise(F.col("p1")))


def test_stratified_two_per_topic(spark):
    got = X.stratified_docs(strata_docs(spark), 2, "genre", seed=1).collect()
    per = {}
    for r in got:
        per.setdefault(r["topic"], []).append(r["docid"])
    assert sorted(per) == [0, 1] and all(len(v) == 2 for v in per.values())
    assert 2 in per[0] and len({0, 1} & set(per[0])) == 1


def test_stratified_missing_column_and_zero_weights(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (2, 0, 0.0)], "docid long, topic int, w double")
    got = X.stratified_docs(df, 3, "genre", seed=0).collect()
    assert sorted(r["docid"] for r in got) == [0, 1, 2]


def test_stratified_is_deterministic_and_partition_independent(spark):
    df = strata_docs(spark)
    a = sorted(map(tuple, X.stratified_docs(df, 2, "genre", seed=5).collect()))
    b = sorted(map(tuple, X.stratified_docs(df.repartition(5), 2, "genre", seed=5).collect()))
    assert a == b


def test_sample_per_topic(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "docid long, topic int")
    got = X.sample_per_topic(df, 0.25, seed=3).groupBy("topic").count().collect()
    assert sorted((r["topic"], r["count"]) for r in got) == [(0, 2), (1, 2), (2, 2)]
    tiny = X.sample_per_topic(df, 0.0, seed=3).groupBy("topic").count().collect()
    assert all(r["count"] == 1 for r in tiny)


def test_topic_label_map_literal(spark):
    info = spark.createDataFrame([(7, "7: Seven", "7: SevenCustom"), (3, "3: Three", None), (-1, "-1: Outlier", None)],
                                 "topic int, name string, custom_name string")
    got = {r["topic"]: r["display_label"] for r in L.topic_label_map(info).collect()}
    assert got == {7: "SevenCustom", 3: "Three", -1: "Outlier"}


def test_scatter_labels_keep_topics(spark):
    pts = spark.createDataFrame([(0, 10), (1, 2), (2, 10)], "docid long, topic int")
    labels = spark.createDataFrame([(10, "Ten"), (2, "Two")], "topic int, label string")
    got = [r["label"] for r in M.map_lookup(pts, labels).orderBy("docid").collect()]
    assert got == ["Ten", "Two", "Ten"]
    other = spark.createDataFrame([(0, -1), (1, 5)], "docid long, topic int")
    assert [r["label"] for r in M.map_lookup(other, labels).orderBy("docid").collect()] == ["Other", "Unknown"]


def test_labels_csv_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(0, "0: alpha_beta"), (1, "1: gamma")], "topic int, label string")
    path = str(tmp_path / "labels")
    S.export_labels(labels, path)
    back = spark.read.schema(S.LABELS_CSV).option("header", True).csv(path)
    assert sorted(map(tuple, back.collect())) == [(0, "alpha_beta"), (1, "gamma")]
    # import over current labels; unknown topic 999 is ignored
    extra = spark.createDataFrame([(999, "nine"), (1, "new one")], "topic_id int, custom_label string")
    p2 = str(tmp_path / "labels2")
    extra.write.option("header", True).csv(p2)
    got = {r["topic"]: r["custom_label"] for r in S.import_labels(spark, p2, labels).collect()}
    assert got == {0: "0: alpha_beta", 1: "new one"}


def test_labels_csv_wrong_columns(spark, tmp_path):
    bad = spark.createDataFrame([(1, "x")], "id int, label string")
    p = str(tmp_path / "bad")
    bad.write.option("header", True).csv(p)
    with pytest.raises(ValueError):
        S.import_labels(spark, p, spark.createDataFrame([(1, "1: a")], "topic int, label string"))


def test_generate_labels_and_fallback(spark):
    top = spark.createDataFrame([(0, 1, "a"), (0, 2, "b_"), (0, 3, "c"), (1, 1, "x")], "topic int, rank int, term string")
    topics = spark.createDataFrame([(0,), (1,), (2,)], "topic int")
    got = {r["topic"]: r["label"] for r in L.generate_labels(top, 3, topics).collect()}
    assert got == {0: "0: a_b__c", 1: "1: x", 2: "2: 2"}
    sugg = spark.createDataFrame([(0, "Label"), (1, "")], "topic int, suggestion string")
    fb = {r["topic"]: r["label"] for r in L.label_fallback(sugg, top).collect()}
    assert fb == {0: "0: Label", 1: "1: x"}


def test_aspect_fill(spark):
    asp = spark.createDataFrame([("Main", 0, 1, "a", 0.5)], "aspect string, topic int, rank int, term string, score double")
    main = spark.createDataFrame([(0, 1, "a", 0.5), (1, 1, "z", 0.4)], "topic int, rank int, term string, score double")
    topics = spark.createDataFrame([(0,), (1,), (2,)], "topic int")
    got = sorted((r["aspect"], r["topic"], r["term"], r["score"]) for r in L.aspect_fill(asp, main, topics, ["Main", "POS"]).collect())
    assert got == [("Main", 0, "a", 0.5), ("Main", 1, "z", 1.0), ("POS", 0, "a", 1.0), ("POS", 1, "z", 1.0)]


def test_labeler_by_rule_and_fallback(spark):
    """The rule-based labeler reads the keywords of the prompt; a topic without a long one falls back."""
    top = spark.createDataFrame([(0, 1, "ab"), (0, 2, "landscape"), (0, 3, "mountains"), (1, 1, "sea"), (1, 2, "sky"), (-1, 1, "odds")], "topic int, rank int, term string")
    docs = spark.createDataFrame([(0, 7, ["described", "by"]), (1, 8, ["x"])], "topic int, docid long, tokens array<string>")
    prompts = L.llm_prompt_table(docs, top)
    suggested = L.labeler("longest_keyword")(prompts)
    assert {tuple(r) for r in suggested.collect()} == {(0, "landscape"), (1, ""), (-1, "")}
    labels = {tuple(r) for r in L.label_fallback(suggested, top).collect()}
    assert labels == {(0, "0: landscape"), (1, "1: sea_sky"), (-1, "-1: odds")}
    with pytest.raises(ValueError, match="longest_keyword"):
        L.labeler("none")
