"""Operators 3, 4, 5 and 6 against brute force."""

import random
import re
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from topicspark.llm import exact_dedup, ngram_join, substring_dedup, syncmers
from topicspark.llm.components import connected_components

from .conftest import awkward_rows, words

WHITE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return [w for w in WHITE.split(text or "") if w]


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=str)


# exact dedup

def exact_groups(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(WHITE.sub(" ", t or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha256(body.encode()).hexdigest()) for i in set(ids)]
    return sorted(out, key=str)


def test_op5_on_awkward_rows(awkward, nothing):
    assert by_key(exact_dedup.dedup_report(awkward).collect()) == exact_groups(awkward_rows())
    assert exact_dedup.dedup_report(nothing).count() == 0


def test_op5_compares_bytes_where_digests_collide(awkward):
    assert by_key(exact_dedup.dedup_report(awkward, digest_bytes=0).collect()) == exact_groups(awkward_rows())


def test_op5_keeps_whole_rows(awkward):
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    want = [(i, t) for i, keep, _, stays, sha in exact_groups(awkward_rows()) if stays
            for t in {t for j, t, *_ in awkward_rows() if j == i and sha256(WHITE.sub(" ", t or "").encode()).hexdigest() == sha}]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


# n-gram join

def shingles(text, n):
    w = plain_words((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}


def components(rows, n, t):
    """Union of all linked pairs; rows without an id only take the component of equal sets."""
    sets = [(i, shingles(x, n)) for i, x, *_ in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    root = list(range(len(known)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(known)):
        for b in range(a):
            both = len(known[a][1] & known[b][1])
            if 100 * both >= t * (len(known[a][1]) + len(known[b][1]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(known):
        least[find(k)] = min(i, least.get(find(k), i))
    named = {frozenset(s): least[find(k)] for k, (_, s) in enumerate(known)}
    return sorted(((i, len(s), named.get(frozenset(s)) if s else i) for i, s in sets), key=str)


def test_op3_on_awkward_rows(awkward, nothing):
    for n, t in ((3, 90), (5, 80)):
        assert by_key(ngram_join.jaccard_components(awkward, n, t).collect()) == components(awkward_rows(), n, t)
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_op3_on_groups_of_edited_copies(spark):
    """Copies with few and many edits: hubs link some, the rest must be found among themselves."""
    rng = random.Random(11)
    rows, i = [], 0
    for size in (60, 25, 150):
        base = words(rng, size, 80).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(size)] = f"edit{rng.randrange(1000)}"
            rows.append((i, " ".join(w)))
            i += 7
    rng.shuffle(rows)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert by_key(got) == components(rows, 3, 90)


def test_op3_keeps_one_of_each_group(awkward):
    kept = ngram_join.keep_one(awkward, 5, 80)
    gone = {i for i, _, c in components(awkward_rows(), 5, 80) if i is not None and c is not None and c < i}
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in awkward_rows() if r[0] not in gone), key=str)


def test_op3_removes_rows_not_ids(spark):
    """Of rows that share a doc_id only the near copy goes, and of near copies that share one, one stays."""
    rng = random.Random(17)
    base, clean, other = (words(rng, 200, 5000) for _ in range(3))
    near = lambda t: t + " one more"
    rows = [(1, base), (2, near(base)), (2, clean), (3, other), (3, near(other)), (4, ""), (4, ""), (5, near(clean)), (None, base), (None, base)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, place int")
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    threes = [r for r in got if r[0] == 3]
    assert len(threes) == 1 and threes[0] in rows
    assert by_key(r for r in got if r[0] != 3) == by_key([(1, base), (2, clean), (4, ""), (4, ""), (None, base), (None, base)])
    twice = spark.createDataFrame([(7, base), (7, base), (8, near(base))], "doc_id bigint, text string")
    assert [tuple(r) for r in ngram_join.keep_one(twice, 5, 80).collect()] == [(7, base)]


def test_op3_links_sizes_far_apart(spark):
    rng = random.Random(19)
    rows = []
    for k, size in enumerate((12, 16, 30, 60)):
        w = [f"t{k}w{j}" for j in range(size)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w, *(f"x{rng.randrange(10**6)}" for _ in range((size - 2) * 3 // 7))]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for t in (70, 50):
        got = by_key(ngram_join.jaccard_components(docs, 3, t).collect())
        assert got == components(rows, 3, t) and len({c for _, _, c in got}) == 4


def test_op3_parity_maps_never_exceed_the_difference(spark):
    """Also where one map is twice as long as the other and is folded, or is not compared."""
    rng = random.Random(23)
    rows = []
    for _ in range(300):
        both, a, b = (rng.sample(range(-2**40, 2**40), rng.randrange(0, top)) for top in (300, 60, 60))
        ka, kb = np.array(both + a, np.int64), np.array(both + b, np.int64)
        rows.append((ngram_join._parity(ka).tolist(), ngram_join._parity(kb).tolist(), len(a) + len(b)))
    docs = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, apart int")
    got = docs.select(ngram_join._differing("x", "y").alias("bits"), "apart", F.size("x").alias("nx"), F.size("y").alias("ny")).collect()
    assert all(r["bits"] <= r["apart"] for r in got)
    assert any(r["nx"] == 2 * r["ny"] and r["bits"] > 0 for r in got)
    near = [r for r in got if r["nx"] == r["ny"]]
    assert sum(r["bits"] for r in near) > 0.85 * sum(r["apart"] for r in near)


def test_op3_near_misses_and_shared_passages(spark):
    """Copies with edits around the threshold, and texts of which half is a passage that all share."""
    rng = random.Random(29)
    for n, t, most in ((3, 90, 12), (5, 80, 14)):
        base, passage, rows = words(rng, 220, 5000).split(), words(rng, 60, 5000), []
        for _ in range(120):
            w = list(base)
            for _ in range(rng.randrange(2, most)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
        rows += [(len(rows) + k, f"{words(rng, 60, 5000)} {passage}") for k in range(60)]
        rng.shuffle(rows)
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n, t).collect()
        assert by_key(got) == components(rows, n, t)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 502)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 502: 500}
    assert connected_components(edges.limit(0)).count() == 0


# substring dedup

def removal(rows, size=50):
    first = {}
    for i, t, *_ in rows:
        w = plain_words(t)
        rank = float("inf") if i is None else i
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, t, *_ in rows:
        w, rank = plain_words(t), float("inf") if i is None else i
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < rank:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op4_on_awkward_rows(awkward, nothing):
    assert by_key(substring_dedup.removal_report(awkward).collect()) == removal(awkward_rows())
    assert substring_dedup.removal_report(nothing).count() == 0


def test_op4_with_many_slices_and_intervals(spark):
    rng = random.Random(2)
    shared = [words(rng, 55, 10_000) for _ in range(3)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randrange(0, 80), 10_000) for _ in range(3)]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts)), s)
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = substring_dedup.dedup_substrings(docs, docs_per_slice=7)
    got = sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], sha256(r["kept"].encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == removal(rows)
    for r in out.collect():
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_op4_changes_only_documents_that_repeat(awkward):
    out = substring_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns and out.count() == len(awkward_rows())
    lost = {i for i, _, n, _ in removal(awkward_rows()) if n}
    before = sorted(((i, t) for i, t, *_ in awkward_rows() if i not in lost), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] not in lost), key=str) == before


# syncmers

def test_op6_on_awkward_rows(awkward, nothing):
    got = syncmers.fingerprint_report(awkward).collect()
    rows = sorted({(i, t or "") for i, t, *_ in awkward_rows()}, key=lambda r: str(r))
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=str) == sorted(((i, len(t)) for i, t in rows), key=str)
    one = [r for r in got if r["doc_id"] is not None]
    order = sorted((r for r in rows if r[0] is not None), reverse=True)
    edited = {}
    for (i, t), (_, after) in zip(order, order[1:]):
        third = len(t) // 3
        edited[i] = sha256((t[:len(t) - third] + after[:third]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in one if r["doc_id"] in edited} == edited
    anchors = lambda s: {x.split(":")[0] for x in s.split()}
    text = dict(rows)
    for r in got:
        a, b = anchors(r["fingerprint"]), anchors(r["edited_fingerprint"])
        assert abs(r["near_edited"] - (2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)) < 1e-12
        assert (r["fingerprint"] == "") == (not plain_words(text.get(r["doc_id"], "x")))
    same = {}
    for r in one:
        assert same.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert syncmers.fingerprint_report(nothing).count() == 0


def test_op6_anchors_are_free_of_context(spark):
    rng = random.Random(4)
    passage = words(rng, 60, 10_000)
    rows = [(1, words(rng, 30, 10_000) + " " + passage), (2, passage + " " + words(rng, 45, 10_000)), (3, words(rng, 100, 10_000)), (4, passage)]
    df = syncmers.with_anchors(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", "own").select("doc_id", "own")
    got = {r["doc_id"]: {x["a"]: x["at"] for x in r["own"]} for r in df.collect()}
    assert got[4].keys() <= got[1].keys() and got[4].keys() <= got[2].keys() and not got[4].keys() & got[3].keys()
    assert {got[1][a] - at for a, at in got[4].items()} == {30} and len(got[4]) > 10


def test_long_words_that_polynomials_confuse(spark):
    """A Thue-Morse word and its complement have one polynomial hash in every odd base; they are different words."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(4)
    common = words(rng, 49)
    docs = spark.createDataFrame([(1, f"{word} {common}"), (2, f"{other} {common}"), (3, word), (4, other)], "doc_id bigint, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removal_report(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0}
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, 3, 90).collect()}
    assert linked[3] == 3 and linked[4] == 4


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the helpers' own, in any case, come back whole."""
    names = ["__sha", "__KEEP", "__keep_sha", "__body", "__id", "__text", "__gone"]
    rng = random.Random(5)
    body = words(rng, 40)
    rows = [(1, body), (2, body), (2, body), (3, body + " more"), (4, words(rng, 40)), (5, None), (None, body), (None, "x")]
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    plain = docs.select("doc_id", "text")
    for stage in (exact_dedup.deduplicate, ngram_join.keep_one):
        got = stage(docs)
        assert got.columns == docs.columns
        assert all(r[n] == f"{n}{r['__sha'].removeprefix('__sha')}" for r in got.collect() for n in names)
        assert by_key(got.select("doc_id", "text").collect()) == by_key(stage(plain).collect())
