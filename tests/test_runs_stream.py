"""Saved runs, fingerprints and the streaming assignment."""


from topicspark.sources import runs as R


def test_save_load_run(spark, tmp_path):
    t = spark.createDataFrame([(0, "a"), (1, "b")], "topic int, term string")
    path = str(tmp_path / "run")
    R.save_run(spark, path, {"topic_terms": t}, {"x": 1}, "fp1")
    run = R.load_run(spark, path, "fp1")
    assert sorted(map(tuple, run["topic_terms"].collect())) == [(0, "a"), (1, "b")]
    assert run["probs"] is None
    assert R.load_run(spark, path, "other") is None
    assert R.load_run(spark, str(tmp_path / "missing")) is None


def test_fingerprint_order_insensitive(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "docid long, text string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "docid long, text string").repartition(2)
    fa = R.corpus_fingerprint(a, {"k": 1}).first()
    fb = R.corpus_fingerprint(b, {"k": 1}).first()
    assert fa == fb
    assert R.corpus_fingerprint(a, {"k": 2}).first()["key"] != fa["key"]


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    sf = "/root/testdata/sf0.001"
    s = sorted(map(tuple, qs["stream_assign"](spark, sf).collect()))
    b = sorted(map(tuple, qs["assign_new"](spark, sf).collect()))
    assert s == b and len(s) > 0


def test_texts_without_a_known_term_are_assigned_to_minus_one(spark, tmp_path, monkeypatch):
    from topicspark.operators import model as K
    from topicspark.plans import q_model as QM
    from topicspark.streaming.assign import assign_batch
    rows = [(1, 0, "apple pie"), (1, 1, ""), (2, 0, None), (2, 1, "zzz"), (None, 0, "?!")]
    conv = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    conv.write.parquet(str(tmp_path / "conversations.parquet"))
    idf = spark.createDataFrame([("apple", 1, 2), ("pie", 2, 2)], "term string, df long, n_units long")
    cents = K.centroid_array(spark.createDataFrame([(0, d, 1.0 if d % 2 else -0.5) for d in range(64)] + [(1, d, -1.0 if d % 2 else 0.5) for d in range(64)],
                                                   "topic int, dim int, value double"), 64)
    streamed = assign_batch(conv, idf, cents, ["conv_id", "turn"])
    monkeypatch.setattr(QM, "corpus_idf", lambda spark, sf: idf)
    monkeypatch.setattr(QM, "_topic_vectors_e1", lambda spark, sf: cents)
    queried = QM.q_assign_new(spark, str(tmp_path))
    for got in (streamed, queried):
        by = {(r["conv_id"], r["turn"]): (r["topic"], r["similarity"]) for r in got.collect()}
        assert set(by) == {(c, t) for c, t, _ in rows} and got.count() == len(rows)
        assert by[1, 0][0] >= 0 and by[1, 0][1] > 0
        assert all(by[k] == (-1, None) for k in by if k != (1, 0))


def test_text_corpus_is_written_a_file_a_document_without_a_folder_each(spark, tmp_path):
    import os

    from topicspark.sources.tables import read_text_corpus, write_text_corpus
    rows = [("doc1.txt", "one\ntwo\n"), ("_a/b%.é.txt", "ü"), (".x.txt", ""), ("n.txt", None), (None, "nameless"), ("same.txt", "a"), ("same.txt", "b")]
    docs = spark.createDataFrame(rows, "filename string, text string").repartition(3, "filename")
    folders = write_text_corpus(docs, str(tmp_path / "corpus"))
    files = [os.path.join(at, f) for at, _, found in os.walk(tmp_path / "corpus") for f in found]
    assert len(folders) <= 3 and len(files) == 6 and {os.path.dirname(f) for f in files} == set(folders)
    got = {tuple(r) for r in read_text_corpus(spark, folders, written=True).collect()}
    assert got == {("doc1.txt", "doc1", "one\ntwo\n"), ("_a/b%.é.txt", "_a/b%.é", "ü"), (".x.txt", ".x", ""), ("n.txt", "n", ""),
                   (None, None, "nameless"), ("same.txt", "same", "a\nb")}
    none = write_text_corpus(docs.limit(0), str(tmp_path / "none"))
    assert read_text_corpus(spark, none, written=True).count() == 0
