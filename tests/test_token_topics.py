"""L7 with few and with all terms sent to every task, against a loop over tokens."""

import re

import pytest
from pyspark.sql import functions as F

from topicspark.operators import analytics as A


@pytest.mark.parametrize("pairs", [1, 4, 1000])
@pytest.mark.parametrize("assigned", [True, False])
def test_tokens_meet_the_best_topic_of_their_document(spark, pairs, assigned):
    docs = [(1, "a b a c zz"), (2, "a c d"), (3, "b d"), (3, "d c a"), (4, ""), (5, None), (None, "a")]
    phi = [(0, "a", 0.5), (1, "a", 0.5), (2, "a", 0.1), (0, "b", 0.2), (2, "b", 0.3), (1, "c", 0.5), (2, "d", 0.6)]
    own = {1: {0, 1}, 2: {2}, 4: {0}}
    got = A.token_topics(spark.createDataFrame(docs, "docid bigint, text string"), spark.createDataFrame(phi, "topic int, term string, phi double"),
                         spark.createDataFrame([(d, t) for d, ts in own.items() for t in ts], "docid bigint, topic int") if assigned else None,
                         F.when(F.col("text") != "", F.split("text", " ")), pairs=pairs)
    assert got.columns == ["docid", "pos", "term", "best_topic"]
    want = []
    for d, text in docs:
        for i, term in enumerate((text or "").split()):
            found = [(-p, t) for t, x, p in phi if x == term and (not assigned or t in own.get(d, ()))]
            want.append((d, i, term, min(found)[1] if found else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # before, all tokens were dealt by document and term
    assert not re.search(r"hashpartitioning\(docid#\d+L?, term", got._jdf.queryExecution().toString())
