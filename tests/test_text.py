"""Literal cases of the reference's tests (code frequencies, katakana sentences) and text helpers."""

import re
import time
from collections import Counter

from pyspark.sql import functions as F

from topicspark.functions import text as T


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def test_code_frequencies_literal(spark):
    c = _one(spark, T.code_frequencies("t"), "こんにちは世界ABC")
    assert (c["hiragana"], c["kanji"], c["other"], c["katakana"]) == (5, 2, 3, 0)
    c2 = _one(spark, T.code_frequencies("t"), "カタカナABC")
    assert c2["katakana"] == 4 and c2["other"] == 3


def test_char_histogram_literal(spark):
    df = spark.createDataFrame([("こんにちは世界ABC",)], "t string")
    h = {r["ch"]: r["n"] for r in df.select(F.explode(T.characters("t")).alias("ch")).groupBy("ch").count()
         .withColumnRenamed("count", "n").collect()}
    assert h["こ"] == 1 and h["A"] == 1 and h["ん"] == 1 and sum(h.values()) == 10


def test_long_vowel_counts_as_katakana(spark):
    c = _one(spark, T.code_frequencies("t"), "ーー")
    assert c["katakana"] == 2 and c["hiragana"] == 0


def test_is_katakana_sentence_literal(spark):
    cases = [("カタカナダケノブンショウデス", True), ("ア！", False), ("ワンワン", False),
             ("カタカナとひらがな", False), ("カタカナカナカナカナカナカナナ", False)]
    df = spark.createDataFrame(cases, "t string, expected boolean")
    got = df.select("expected", T.is_katakana_sentence("t").alias("got")).collect()
    assert [r["got"] for r in got] == [r["expected"] for r in got]


def test_empty_text_is_not_katakana(spark):
    assert _one(spark, T.is_katakana_sentence("t"), "") is False


def test_kata2hira(spark):
    assert _one(spark, T.kata2hira("t"), "カタカナ") == "かたかな"


def test_paragraphs_match_python_splitlines(spark):
    text = "a\r\nb\n\nc\x1cd e\n"
    expected = [p for p in text.splitlines() if p]
    assert _one(spark, T.paragraphs("t"), text) == expected


def test_tokenize_ws_matches_python_split(spark):
    text = "a  b\tc　d\xa0e\n f"
    assert _one(spark, T.tokenize_ws("t"), text) == text.split()


def test_strip_prefix_and_think(spark):
    df = spark.createDataFrame([(3, "3: Three"), (3, "Three"), (4, "3: x")], "topic int, label string")
    got = [r[0] for r in df.select(T.strip_topic_prefix("label", "topic")).collect()]
    assert got == ["Three", "Three", "3: x"]
    assert _one(spark, T.strip_think_tags("t"), " <think>a</think> b ") == "a b"


def test_ngrams_and_split_fixed(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert df.select(T.ngrams("t", 1, 2)).first()[0] == ["a", "b", "c", "a b", "b c"]
    assert df.select(T.split_fixed("t", 2)).first()[0] == [["a", "b"], ["c"]]
    empty = spark.createDataFrame([([],)], "t array<string>")
    assert empty.select(T.split_fixed("t", 2)).first()[0] == []


def test_tagged_token_functions(spark):
    tagged = [{"pos": 0, "orth": "Tokyo", "lemma": None, "pos1": "名詞", "pos2": "固有名詞"},
              {"pos": 1, "orth": "、", "lemma": None, "pos1": "補助記号", "pos2": "一般"},
              {"pos": 2, "orth": "cats", "lemma": "cat", "pos1": "名詞", "pos2": "一般"}]
    df = spark.createDataFrame([(tagged,)], "t array<struct<pos:int,orth:string,lemma:string,pos1:string,pos2:string>>")
    assert df.select(F.transform(T.pos_filter("t", ["補助記号"]), lambda x: x["orth"])).first()[0] == ["Tokyo", "cats"]
    assert df.select(T.token_features("t", ["orth", "lemma"])).first()[0] == ["Tokyo/", "、/", "cats/cat"]
    assert df.select(T.proper_noun_blank("t")).first()[0] == ["", "、", "cat"]
    assert df.select(F.transform("t", lambda x: T.lemma_fallback(x["lemma"], x["orth"]))).first()[0] == ["Tokyo", "、", "cat"]


def test_katakana_sentence_of_a_long_paragraph(spark):
    """The repetition checks take time in proportion to a paragraph's length."""
    plain = "".join(chr(0x30A2 + (i * i * 7 + i * 3) % 61) for i in range(600_000))
    mostly_one = "ア" * 9 + "イウエオ"
    begin = time.monotonic()
    got = spark.createDataFrame([(0, plain), (1, mostly_one)], "i int, t string").repartition(1).select("i", T.is_katakana_sentence("t")).collect()
    assert time.monotonic() - begin < 60
    assert dict(got) == {0: is_kata(plain), 1: is_kata(mostly_one)}


def is_kata(t):
    """The rules, one after the other."""
    n, kata = len(t), sum(0x30A1 <= ord(c) <= 0x30F6 or ord(c) == 0x30FC for c in t)
    if n == 0 or any(0x3041 <= ord(c) <= 0x3096 for c in t) or kata / n <= 0.5 or n < 8 or (n < 10 and t[-2:] in ("？」", "！」")):
        return False
    pairs = Counter(t[i:i + 2] for i in range(n - 1))
    return not ((n < 100 and len(set(t)) / n < 0.5) or max(pairs.values()) / n > 0.5
                or len(re.findall(r"(.)\1+", t)) / n > 0.1 or len(re.findall(r"(..)ッ?\1", t)) / n > 0.1)


def test_katakana_sentence_repetition_rules(spark):
    texts = ["ア" * k + "イウエオカキクケコサシスセソタチツテト"[:m] for k in range(1, 200, 13) for m in range(0, 20, 3)]
    texts += ["アイ" * k + "ウエオカキクケコ" for k in (1, 3, 30, 80)] + ["アアアアアアアア", "アァイィウゥエェ", "", "アイウエオカキ", "アイウエオカキ！」"]
    texts += ["".join("アイウエオカキクケコ"[j % 10] for j in range(110)) + "ン" * k for k in (50, 105, 120, 300)]
    got = dict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.is_katakana_sentence("t")).collect())
    assert got == {i: is_kata(t) for i, t in enumerate(texts)}


def test_tagger_looks_a_class_up_once(spark):
    from topicspark.functions import tagging as TG

    df = spark.createDataFrame([("Élan vital, x2 $5 \u3000 Ⓐ世界 İz _",)], "t string").select(TG.default_tagger("t").alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count(TG.WORD_RX) == 1
    got = [(t["pos"], t["orth"], t["lemma"], t["pos1"], t["pos2"]) for t in df.first()["x"] if t["pos1"] != "空白"]
    assert got == [(0, "Élan", "élan", "名詞", "一般"), (2, "vital", "vital", "名詞", "一般"), (3, ",", None, "補助記号", "一般"), (5, "x2", "x2", "名詞", "一般"),
                   (7, "$", None, "記号", "一般"), (8, "5", "5", "名詞", "一般"), (10, "\u3000", None, "記号", "一般"), (12, "Ⓐ", None, "記号", "一般"),
                   (13, "世界", "世界", "名詞", "一般"), (15, "İz", "i̇z", "名詞", "固有名詞"), (17, "_", None, "補助記号", "一般")]
