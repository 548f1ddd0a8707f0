"""Tagged tokens (D6) and the tokenizer plug-in point.

The reference tags tokens with morphological analysers that are not available
here.  A tagger is any function ``Column(text) -> Column(array<struct>)`` with
the D6 fields; ``register_tokenizer`` makes one available by name.  The
default tagger is rule-based: letter/digit runs are nouns (名詞), with pos2
固有名詞 for a capitalised word that is not the first token; punctuation is
補助記号, symbols 記号, whitespace runs 空白.  Lemma = lower-cased word, NULL
for non-words (unknown lemma, so the surface fallback applies).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGGED_TYPE = "array<struct<pos:int,orth:string,lemma:string,pos1:string,pos2:string>>"

# Token pattern and classes of the default tagger.
TAG_TOKEN = r"[\p{L}\p{M}\p{N}]+|[ \t\n\f\r]+|[^\p{L}\p{M}\p{N} \t\n\f\r]"
WORD_RX = r"^[\p{L}\p{M}\p{N}]+$"
SPACE_RX = r"^[ \t\n\f\r]+$"
PUNCT_RX = r"^\p{P}$"
UPPER_RX = r"^\p{Lu}"


def default_tagger(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(t, F.lit(TAG_TOKEN), 0)

    def one(tok, i):
        # a token is a run of one class, or one character: its class is looked up once
        pos2 = F.when((i > 0) & tok.rlike(UPPER_RX), F.lit("固有名詞")).otherwise(F.lit("一般"))
        other = F.when(tok.rlike(SPACE_RX), F.lit("空白")).when(tok.rlike(PUNCT_RX), F.lit("補助記号")).otherwise(F.lit("記号"))

        def tagged(lemma, pos1, pos2):
            return F.struct(i.cast("int").alias("pos"), tok.alias("orth"), lemma.alias("lemma"), pos1.alias("pos1"), pos2.alias("pos2"))

        return F.when(tok.rlike(WORD_RX), tagged(F.lower(tok), F.lit("名詞"), pos2)).otherwise(
            tagged(F.lit(None).cast("string"), other, F.lit("一般")))

    return F.transform(toks, one)


SQL_TAGGER = r"""list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{N}}]+|[ \t\n\f\r]+|[^\p{{L}}\p{{M}}\p{{N}} \t\n\f\r]'),
  lambda tok, i: {{'pos': CAST(i - 1 AS INTEGER), 'orth': tok,
     'lemma': CASE WHEN regexp_matches(tok, '^[\p{{L}}\p{{M}}\p{{N}}]+$') THEN lower(tok) END,
     'pos1': CASE WHEN regexp_matches(tok, '^[\p{{L}}\p{{M}}\p{{N}}]+$') THEN '名詞'
                  WHEN regexp_matches(tok, '^[ \t\n\f\r]+$') THEN '空白'
                  WHEN regexp_matches(tok, '^\p{{P}}$') THEN '補助記号' ELSE '記号' END,
     'pos2': CASE WHEN regexp_matches(tok, '^[\p{{L}}\p{{M}}\p{{N}}]+$') AND regexp_matches(tok, '^\p{{Lu}}') AND i > 1
                  THEN '固有名詞' ELSE '一般' END}})"""


def sql_tagger(text_expr: str) -> str:
    return SQL_TAGGER.format(text=text_expr)


_TOKENIZERS: dict[str, Callable] = {"default": default_tagger}


def register_tokenizer(name: str, fn: Callable) -> None:
    """Make a tagger (Column text -> Column of D6 array) available by name.

    A tagger backed by an analyser library should be an Iterator pandas_udf
    returning TAGGED_TYPE, so the analyser loads once per task.
    """
    _TOKENIZERS[name] = fn


def tagger(name: str = "default") -> Callable:
    return _TOKENIZERS[name]
