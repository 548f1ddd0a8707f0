import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, slice string, row string, rank string, length string"


def words(rng, n, base=500):
    return " ".join(f"w{rng.randrange(base)}x" for _ in range(n))


def awkward_rows():
    """Null and empty texts, repeated rows, shared passages, near copies, a very long text, an id that is null."""
    rng = random.Random(7)
    passage = words(rng, 70)
    long = words(rng, 30_000, 5000)
    base = words(rng, 200)
    near = base.split()
    near[5] = "changed"
    half = base.split()[:100] + words(rng, 100).split()
    texts = [
        (1, base), (2, " ".join(near)), (3, base.upper()), (4, base.replace(" ", "\n")), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "One"),
        (10, "two words"), (11, passage + " tail one"), (12, "head " + passage), (13, passage), (13, passage), (14, long), (15, long + " more"),
        (16, " ".join(half)), (None, base), (None, "nothing else like this one here"), (17, "a" * 5000), (18, "ab " * 200), (19, "été 日本  \x1c café " * 30),
        (20, "the same\tline\nthe same line"), (21, "<|endoftext|> <|im_start|>"),
    ]
    return [(i, t, None, "s", None if t is None else len(t), "x", None, "y", "z", None) for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
