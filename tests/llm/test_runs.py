"""Operator 13 against brute force."""

import itertools
import random
from hashlib import sha256

import numpy as np

from topicspark.llm import periodic_runs as R

from .conftest import awkward_rows


def brute(w, least):
    """Every period in turn: stretches of places whose word stands again a period on; the smallest period of each stretch."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def found(w, least):
    return sorted(map(tuple, R.find_runs(np.array(w), least).tolist()))


def test_every_short_word():
    for n in range(1, 10):
        for w in itertools.product((0, 1), repeat=n):
            assert found(w, 2) == brute(w, 2), w


def test_nested_repeats():
    rng = random.Random(1)
    for _ in range(300):
        n, k, w = rng.randrange(1, 250), rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < n:
            if w and rng.random() < 0.6:
                root = w[-rng.randrange(1, len(w) + 1):]
                w += (root * 4)[:rng.randrange(1, 3 * len(root) + 2)]
            else:
                w.append(rng.randrange(k))
        least = rng.choice([2, 5, 12])
        assert found(w[:n], least) == brute(w[:n], least)


def test_many_periods_around_one_break():
    """...babab|ababa...: every odd period has a run of twice its length around the break."""
    for m in (5, 16, 33, 60):
        half = [i % 2 for i in range(m)]
        assert found(half[::-1] + half, 2) == brute(half[::-1] + half, 2)


def test_texts_found_together_are_those_found_alone():
    rng = random.Random(2)
    lists = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    together = [[tuple(x) for x in r.tolist()] for r in R.runs_of_texts(lists, 4)]
    assert together == [brute(w, 4) if w else [] for w in lists]


def wanted(doc_id, text):
    words = R.periodic_words((text or "").encode().split(), doc_id)
    runs = brute(words, 12)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    covered = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in covered)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_op13_on_awkward_rows(spark, awkward, nothing):
    rows = [r for r in awkward_rows() if len(r[1] or "") < 20_000]
    docs = awkward.filter("text IS NULL OR length(text) < 20000")
    got = sorted((tuple(r) for r in R.run_report(docs).collect()), key=str)
    assert got == sorted((wanted(r[0], r[1]) for r in rows), key=str)
    assert R.run_report(nothing).count() == 0
    whole = R.run_report(awkward)
    assert whole.count() == len(awkward_rows())  # the very long texts too


def test_op13_rewritten_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 120)))) for i in range(300)]
    got = sorted(tuple(r) for r in R.run_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted(wanted(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 15


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y", 9), (2, "", 9)], "doc_id bigint, text string, runs int")
    rows = {r["doc_id"]: r for r in R.periodic_runs(docs).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(1, 15, 3)] and rows[1]["collapsed"] == "x a b c y"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == ""
