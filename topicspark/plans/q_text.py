"""Registered queries: text and Japanese scalar functions.

Every query runs over all documents (or all their paragraphs); long outputs
are summarised per document as (count, md5 of the joined tokens), which
checks every token while keeping the result small.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.functions import tagging as TG
from topicspark.functions import text as T
from topicspark.plans import common as C
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import query, with_ctes
from topicspark.sources.tables import table

# Fixed values of the katakana rendering used for the katakana-sentence checks.
KATA_FROM = "abcdefghijklmnopqrstuvwxyz"
KATA_TO = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"

SQL_KANA = f"""kana AS (
  SELECT doc_id AS docid, translate(lower(text), '{fx.KANA_FROM}', '{fx.KANA_TO}') AS t FROM documents)"""
SQL_KATA_PARAS = f"""ka AS (
  SELECT doc_id AS docid, regexp_split_to_array(translate(lower(text), '{KATA_FROM}', '{KATA_TO}'), '{T.LINE_BREAK}') AS arr
  FROM documents),
kl AS (SELECT docid, unnest(arr) AS p, generate_subscripts(arr, 1) - 1 AS line_ix FROM ka),
kp AS (SELECT docid, CAST(line_ix AS INTEGER) AS line_ix, p, length(p) AS n FROM kl WHERE p <> '')"""


def _kana_docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("docid"), fx.kana(F.col("text")).alias("t"))


def _kata_paragraphs(spark, sf):
    d = table(spark, sf, "documents")
    kt = F.translate(F.lower("text"), KATA_FROM, KATA_TO)
    return (d.select(F.col("doc_id").alias("docid"), F.posexplode(T.lines(kt)).alias("line_ix", "p"))
            .where(F.col("p") != ""))


def _sql_class_count(expr, cls):
    return f"len(regexp_extract_all({expr}, '{cls}'))"


def _sql_is_kata(p: str, n: str) -> str:
    kata = _sql_class_count(p, T.KATAKANA_CLASS)
    hira = _sql_class_count(p, T.HIRAGANA_CLASS)
    bigrams = f"list_transform(range(1, {n}), lambda i: substr({p}, i, 2))"
    runs = (f"len(list_filter(range(2, {n} + 1), lambda i: substr({p}, i, 1) = substr({p}, i - 1, 1) "
            f"AND (i = 2 OR substr({p}, i - 1, 1) <> substr({p}, i - 2, 1))))")
    rep2 = (f"list_reduce(range(1, {n} + 1), lambda acc, i: CASE WHEN i < acc.nxt THEN acc "
            f"WHEN length(substr({p}, i, 2)) = 2 AND substr({p}, i + 2, 1) = 'ッ' AND substr({p}, i + 3, 2) = substr({p}, i, 2) "
            f"THEN {{'nxt': i + 5, 'cnt': acc.cnt + 1}} "
            f"WHEN length(substr({p}, i, 2)) = 2 AND substr({p}, i + 2, 2) = substr({p}, i, 2) "
            f"THEN {{'nxt': i + 4, 'cnt': acc.cnt + 1}} ELSE acc END, "
            f"{{'nxt': CAST(1 AS BIGINT), 'cnt': CAST(0 AS BIGINT)}}).cnt")
    return f"""CASE WHEN {n} = 0 THEN false
  WHEN NOT ({hira} = 0 AND {kata} / {n} > 0.5) THEN false
  WHEN {n} < 8 THEN false
  WHEN {n} < 10 AND right({p}, 2) IN ('？」', '！」') THEN false
  WHEN {n} < 100 AND len(list_distinct(string_split({p}, ''))) / {n} < 0.5 THEN false
  WHEN list_max(map_values(list_aggregate({bigrams}, 'histogram'))) / {n} > 0.5 THEN false
  WHEN {runs} / {n} > 0.1 THEN false
  WHEN {rep2} / {n} > 0.1 THEN false
  ELSE true END"""


@query("code_frequencies", with_ctes(SQL_KANA) + f"""
SELECT docid, {_sql_class_count('t', T.KATAKANA_CLASS)} AS katakana, {_sql_class_count('t', T.HIRAGANA_CLASS)} AS hiragana,
       {_sql_class_count('t', T.KANJI_CLASS)} AS kanji,
       length(t) - {_sql_class_count('t', T.KATAKANA_CLASS)} - {_sql_class_count('t', T.HIRAGANA_CLASS)}
         - {_sql_class_count('t', T.KANJI_CLASS)} AS other
FROM kana""")
def q_code_frequencies(spark, sf):
    """Katakana / hiragana / kanji / other counts of every document (Japanese rendering)."""
    return _kana_docs(spark, sf).select("docid", T.code_frequencies("t").alias("c")).select("docid", "c.*")


@query("char_histogram", with_ctes(SQL_KANA) + """
SELECT docid, ch, count(*) AS n FROM (SELECT docid, unnest(string_split(t, '')) AS ch FROM kana) GROUP BY 1, 2""")
def q_char_histogram(spark, sf):
    """Frequency of each character in every document."""
    return (_kana_docs(spark, sf).select("docid", F.explode(T.characters("t")).alias("ch"))
            .groupBy("docid", "ch").agg(F.count(F.lit(1)).alias("n")))


@query("is_katakana_sentence", with_ctes(SQL_KATA_PARAS) + f"""
SELECT docid, line_ix, {_sql_is_kata('p', 'n')} AS is_katakana FROM kp""")
def q_is_katakana_sentence(spark, sf):
    """Katakana-sentence test of every paragraph (katakana rendering of the text)."""
    return _kata_paragraphs(spark, sf).select("docid", "line_ix", T.is_katakana_sentence("p").alias("is_katakana"))


@query("kata2hira", with_ctes(SQL_KATA_PARAS) + f"""
SELECT docid, line_ix, md5(CASE WHEN {_sql_is_kata('p', 'n')}
  THEN translate(p, '{T._KATA_SRC}', '{T._HIRA_DST}') ELSE p END) AS text_md5 FROM kp""")
def q_kata2hira(spark, sf):
    """T4: paragraphs that are katakana sentences converted to hiragana."""
    p = _kata_paragraphs(spark, sf)
    return p.select("docid", "line_ix", F.md5(T.kata2hira_if_katakana_sentence("p")).alias("text_md5"))


@query("paragraphs", f"""
SELECT docid, CAST(line_ix AS INTEGER) AS line_ix, paragraph FROM (
  SELECT docid, unnest(arr) AS paragraph, generate_subscripts(arr, 1) - 1 AS line_ix
  FROM (SELECT doc_id AS docid, regexp_split_to_array(text, '{T.LINE_BREAK}') AS arr FROM documents))
WHERE paragraph <> ''""")
def q_paragraphs(spark, sf):
    """T5: non-empty lines of every document with their line index."""
    d = table(spark, sf, "documents")
    return (d.select(F.col("doc_id").alias("docid"), F.posexplode(T.lines("text")).alias("line_ix", "paragraph"))
            .where(F.col("paragraph") != ""))


@query("sentences_ja", with_ctes(SQL_KANA) + f"""
SELECT docid, CAST(ix AS INTEGER) AS ix, sentence FROM (
  SELECT docid, unnest(arr) AS sentence, generate_subscripts(arr, 1) - 1 AS ix FROM (
    SELECT docid, regexp_split_to_array(replace(replace(t, '。', '。' || chr(10)), chr(10) || chr(10), chr(10)), '{T.LINE_BREAK}') AS arr
    FROM kana)) WHERE sentence <> ''""")
def q_sentences_ja(spark, sf):
    """Japanese sentences of every document (split after 。)."""
    return (_kana_docs(spark, sf).select("docid", F.posexplode(T.sentences_ja("t")).alias("ix", "sentence"))
            .where(F.col("sentence") != ""))


@query("sentence_segment", f"""
SELECT docid, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (
  SELECT doc_id AS docid, list_filter(list_transform(regexp_extract_all(text, '{T.SENTENCE}'), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM documents) WHERE len(s) > 0""")
def q_sentence_segment(spark, sf):
    """Rule-based sentences of every document (count and digest per document)."""
    d = table(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("docid"), T.sentence_segment("text").alias("s"))
    return s.where(F.size("s") > 0).select("docid", F.size("s").cast("bigint").alias("n_sentences"),
                                           F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def _digest(arr_col, name="tokens"):
    return [F.size(arr_col).cast("bigint").alias(f"n_{name}"), F.md5(F.array_join(arr_col, " ")).alias(f"{name}_md5")]


def _sql_digest(arr_sql, name="tokens"):
    return f"CAST(len({arr_sql}) AS BIGINT) AS n_{name}, md5(array_to_string({arr_sql}, ' ')) AS {name}_md5"


@query("tokenize_ws", f"""
SELECT doc_id AS docid, {_sql_digest(f"regexp_extract_all(text, '[^{T.WS_CHARS}]+')")} FROM documents""")
def q_tokenize_ws(spark, sf):
    """Whitespace tokens of every document."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("docid"), *_digest(T.tokenize_ws("text")))


@query("tokenize_word", r"""
SELECT doc_id AS docid, """ + _sql_digest(r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')") + " FROM documents")
def q_tokenize_word(spark, sf):
    """Analytical word tokens of every document."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("docid"), *_digest(T.tokenize_word("text")))


@query("script_tokens_ja", with_ctes(SQL_KANA) + f"""
SELECT docid, {_sql_digest(f"regexp_extract_all(t, '{T.SCRIPT_RUN}')")} FROM kana""")
def q_script_tokens_ja(spark, sf):
    """Script-run tokens of every document's Japanese rendering."""
    return _kana_docs(spark, sf).select("docid", *_digest(T.script_tokens_ja("t")))


@query("ws_token_filter", f"""
SELECT doc_id AS docid, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_before,
       {_sql_digest(f"list_filter(string_split(text, ' '), lambda x: NOT regexp_matches(x, '^[{T.WS_CHARS}]*$'))")}
FROM documents""")
def q_ws_token_filter(spark, sf):
    """Single-space split of every document with whitespace-only tokens removed."""
    d = table(spark, sf, "documents")
    raw = F.split("text", " ", -1)
    return d.select(F.col("doc_id").alias("docid"), F.size(raw).cast("bigint").alias("n_before"),
                    *_digest(T.ws_token_filter(raw)))


POS_DROP = ["空白", "補助記号", "記号"]


@query("pos_filter", f"""
SELECT doc_id AS docid, {_sql_digest("list_transform(list_filter(" + TG.sql_tagger('text') + ", lambda t: t.pos1 NOT IN ('空白', '補助記号', '記号')), lambda t: t.orth)")}
FROM documents""")
def q_pos_filter(spark, sf):
    """Tagged tokens of every document without whitespace, punctuation and symbols."""
    d = table(spark, sf, "documents")
    kept = T.pos_filter(TG.default_tagger("text"), POS_DROP)
    return d.select(F.col("doc_id").alias("docid"), *_digest(F.transform(kept, lambda t: t["orth"])))


SURFACE_RX = r"\p{P}"


@query("surface_filter", f"""
SELECT doc_id AS docid, {_sql_digest(f"list_filter(regexp_extract_all(text, '[^{T.WS_CHARS}]+'), lambda x: NOT regexp_matches(x, '{SURFACE_RX}'))")}
FROM documents""")
def q_surface_filter(spark, sf):
    """Whitespace tokens of every document, tokens containing punctuation dropped."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("docid"), *_digest(T.surface_filter(T.tokenize_ws("text"), SURFACE_RX)))


@query("token_features", f"""
SELECT doc_id AS docid, {_sql_digest("list_transform(" + TG.sql_tagger('text') + ", lambda t: concat_ws('/', coalesce(t.orth, ''), coalesce(t.lemma, ''), coalesce(t.pos1, '')))", "features")}
FROM documents""")
def q_token_features(spark, sf):
    """orth/lemma/pos1 feature strings of every tagged token."""
    d = table(spark, sf, "documents")
    feats = T.token_features(TG.default_tagger("text"), ["orth", "lemma", "pos1"])
    # a column of its own: count and digest read it, and lambdas are computed anew in each expression
    return d.select(F.col("doc_id").alias("docid"), feats.alias("feats")).select("docid", *_digest("feats", "features"))


@query("lemma_fallback", f"""
SELECT doc_id AS docid, {_sql_digest("list_transform(" + TG.sql_tagger('text') + ", lambda t: coalesce(nullif(t.lemma, ''), t.orth))", "lemmas")}
FROM documents""")
def q_lemma_fallback(spark, sf):
    """Lemma of every tagged token, surface form where the lemma is unknown."""
    d = table(spark, sf, "documents")
    lem = F.transform(TG.default_tagger("text"), lambda t: T.lemma_fallback(t["lemma"], t["orth"]))
    return d.select(F.col("doc_id").alias("docid"), *_digest(lem, "lemmas"))


@query("proper_noun_blank", f"""
SELECT doc_id AS docid, CAST(len(list_filter(x, lambda s: s = '')) AS BIGINT) AS n_blank, md5(array_to_string(x, '|')) AS tokens_md5 FROM (
  SELECT doc_id, list_transform({TG.sql_tagger('text')}, lambda t: CASE WHEN t.pos2 = '固有名詞' THEN '' ELSE coalesce(nullif(t.lemma, ''), t.orth) END) AS x
  FROM documents)""")
def q_proper_noun_blank(spark, sf):
    """Lemma view of every document with proper nouns blanked in place."""
    d = table(spark, sf, "documents")
    x = T.proper_noun_blank(TG.default_tagger("text"))
    return d.select(F.col("doc_id").alias("docid"), F.size(F.filter(x, lambda s: s == "")).cast("bigint").alias("n_blank"),
                    F.md5(F.array_join(x, "|")).alias("tokens_md5"))


@query("lowercase_by_lang", f"""
SELECT docid, lang, md5(CASE WHEN lang = 'ja' THEN text ELSE lower(text) END) AS text_md5 FROM (
  SELECT doc_id AS docid, lang, text FROM documents
  UNION ALL
  SELECT doc_id, 'ja', translate(text, '{fx.KANA_FROM}', '{fx.KANA_TO}') FROM documents)""")
def q_lowercase_by_lang(spark, sf):
    """Every document and its Japanese rendering, lower-cased except Japanese."""
    d = table(spark, sf, "documents")
    both = d.select(F.col("doc_id").alias("docid"), "lang", "text").unionByName(
        d.select(F.col("doc_id").alias("docid"), F.lit("ja").alias("lang"),
                 F.translate("text", fx.KANA_FROM, fx.KANA_TO).alias("text")))
    return both.select("docid", "lang", F.md5(T.lowercase_by_lang("text", "lang")).alias("text_md5"))


@query("ngrams", r"""
SELECT docid, """ + _sql_digest("list_concat(g1, g2, g3)", "ngrams") + r""" FROM (
  SELECT docid,
    CASE WHEN len(t) >= 1 THEN list_transform(range(1, len(t) + 1), lambda i: array_to_string(t[i:i], ' ')) ELSE [] END AS g1,
    CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')) ELSE [] END AS g2,
    CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) ELSE [] END AS g3
  FROM (SELECT doc_id AS docid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents))""")
def q_ngrams(spark, sf):
    """1- to 3-grams of the word tokens of every document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("docid"), T.tokenize_word("text").alias("t"))
    return d.select("docid", *_digest(T.ngrams("t", 1, 3), "ngrams"))


@query("strip_topic_prefix", C.sql_fix_ctes(C.SQL_TOPWORDS) + """,
lab AS (SELECT topic, string_agg(term, '_' ORDER BY rank) AS words FROM topw WHERE rank <= 3 GROUP BY topic),
variants AS (
  SELECT topic, 'prefixed' AS variant, CAST(topic AS VARCHAR) || ': ' || words AS label FROM lab
  UNION ALL SELECT topic, 'bare', words FROM lab
  UNION ALL SELECT topic, 'other_prefix', CAST(topic + 1 AS VARCHAR) || ': ' || words FROM lab)
SELECT topic, variant, CASE WHEN starts_with(label, CAST(topic AS VARCHAR) || ': ')
  THEN substr(label, length(CAST(topic AS VARCHAR) || ': ') + 1) ELSE label END AS label FROM variants""")
def q_strip_topic_prefix(spark, sf):
    """T19: '{topic}: ' prefixes removed from generated labels, other labels unchanged."""
    top = C.fix_top_words(spark, sf).where(F.col("rank") <= 3)
    lab = top.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                                            lambda s: s["term"]), "_").alias("words"))
    variants = (lab.select("topic", F.lit("prefixed").alias("variant"),
                           F.concat(F.col("topic").cast("string"), F.lit(": "), "words").alias("label"))
                .unionByName(lab.select("topic", F.lit("bare").alias("variant"), F.col("words").alias("label")))
                .unionByName(lab.select("topic", F.lit("other_prefix").alias("variant"),
                                        F.concat((F.col("topic") + 1).cast("string"), F.lit(": "), "words").alias("label"))))
    return variants.select("topic", "variant", T.strip_topic_prefix("label", "topic").alias("label"))


@query("strip_think_tags", """
SELECT conv_id, turn, md5(trim(regexp_replace('<think>' || text || '</think> ' || role, '</?think>', '', 'g'))) AS text_md5
FROM conversations""")
def q_strip_think_tags(spark, sf):
    """Think tags removed from every conversation turn wrapped in them."""
    c = table(spark, sf, "conversations")
    wrapped = F.concat(F.lit("<think>"), "text", F.lit("</think> "), "role")
    return c.select("conv_id", "turn", F.md5(T.strip_think_tags(wrapped)).alias("text_md5"))


@query("split_fixed", r"""
SELECT docid, CAST(i AS INTEGER) AS piece, CAST(len(t[i * 50 + 1:i * 50 + 50]) AS BIGINT) AS n_tokens,
       md5(array_to_string(t[i * 50 + 1:i * 50 + 50], ' ')) AS piece_md5
FROM (SELECT doc_id AS docid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
     LATERAL (SELECT unnest(range(0, CAST(ceil(len(t) / 50) AS BIGINT))) AS i)""")
def q_split_fixed(spark, sf):
    """Word tokens of every document cut into pieces of 50."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("docid"), T.tokenize_word("text").alias("t"))
    return (d.select("docid", F.posexplode(T.split_fixed("t", 50)).alias("piece", "p"))
            .select("docid", "piece", F.size("p").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("p", " ")).alias("piece_md5")))
