"""Registered queries: chunking.

The DuckDB oracle folds the same rules with ``list_reduce``; the pytest suite
checks the Spark fold on spans worked out by hand and on the rules' invariants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.functions import tagging as TG
from topicspark.functions import text as T
from topicspark.operators import chunk as CH
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import query, with_ctes
from topicspark.plans.q_text import _sql_is_kata
from topicspark.sources.tables import table

FAST = CH.ChunkSettings(chunksize=100)
FULL = CH.ChunkSettings(chunksize=250)
MINIMUM = CH.ChunkSettings(chunksize=250, min_chunksize=100)   # only the minimum filter drops chunks
LIMIT = CH.ChunkSettings(chunksize=100, chunks=3)              # only the chunk limit stops early
JA_FAST = CH.ChunkSettings(chunksize=100, language="Japanese")
SENTENCE_CHUNK = 200


def _docs(spark, sf, japanese=False):
    d = table(spark, sf, "documents")
    text = fx.kana(F.col("text")) if japanese else F.col("text")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                    F.concat_ws("_", F.col("source"), F.col("doc_id").cast("string")).alias("title"),
                    text.alias("text"))


def _chunks(spark, sf, settings, japanese=False):
    return CH.chunk_paragraphs(_docs(spark, sf, japanese), settings)


# --- SQL side ------------------------------------------------------------------

def sql_pack(counts: str, c: int, chunks: int) -> str:
    st = "{'s': CAST(%s AS BIGINT), 'l': CAST(%s AS BIGINT)}"
    k = f"CAST(ceil(n / {c}) AS BIGINT)"
    stop = f"{chunks} > 0 AND acc.nc >= {chunks}" if chunks > 0 else "false"
    fold = f"""list_reduce({counts}, lambda acc, n: CASE
    WHEN {stop} THEN acc
    WHEN n >= {c} THEN {{'off': acc.off + n, 'ps': acc.off + ({k} - 1) * {c},
        'pl': n - ({k} - 1) * {c},
        'nc': acc.nc + CASE WHEN acc.pl > 0 THEN 1 ELSE 0 END + {k} - 1,
        'out': list_concat(acc.out, CASE WHEN acc.pl > 0 THEN [{st % ('acc.ps', 'acc.pl')}] ELSE [] END,
                           list_transform(range(0, {k} - 1), lambda j: {st % (f'acc.off + j * {c}', str(c))}))}}
    WHEN n + acc.pl > {c} THEN {{'off': acc.off + n, 'ps': acc.off, 'pl': n, 'nc': acc.nc + 1,
        'out': list_append(acc.out, {st % ('acc.ps', 'acc.pl')})}}
    ELSE {{'off': acc.off + n, 'ps': CASE WHEN acc.pl = 0 THEN acc.off ELSE acc.ps END, 'pl': acc.pl + n,
        'nc': acc.nc, 'out': acc.out}} END,
  {{'off': CAST(0 AS BIGINT), 'ps': CAST(0 AS BIGINT), 'pl': CAST(0 AS BIGINT), 'nc': CAST(0 AS BIGINT),
    'out': CAST([] AS STRUCT(s BIGINT, l BIGINT)[])}})"""
    spans = f"list_concat(f.out, CASE WHEN f.pl > 0 THEN [{st % ('f.ps', 'f.pl')}] ELSE [] END)"
    if chunks > 0:
        spans = f"({spans})[1:{chunks}]"
    return fold, spans


def sql_chunks(s: CH.ChunkSettings, japanese: bool = False) -> str:
    fold, spans = sql_pack("counts", s.chunksize, s.chunks)
    if japanese:
        text = f"translate(lower(text), '{fx.KANA_FROM}', '{fx.KANA_TO}')"
        para = f"""list_transform(list_filter(regexp_split_to_array({text}, '{T.LINE_BREAK}'), lambda p: p <> ''),
                   lambda p: CASE WHEN {_sql_is_kata('p', 'length(p)')} THEN translate(p, '{T._KATA_SRC}', '{T._HIRA_DST}') ELSE p END)"""
        tok = f"regexp_extract_all(p, '{T.SCRIPT_RUN}')"
        sep = ""
    else:
        para = f"list_filter(regexp_split_to_array(text, '{T.LINE_BREAK}'), lambda p: p <> '')"
        tok = f"regexp_extract_all(p, '[^{T.WS_CHARS}]+')"
        sep = " "
    ntok = (f"len(regexp_extract_all(array_to_string(flat[sp.s + 1:sp.s + sp.l], '{sep}'), '{T.SCRIPT_RUN}'))"
            if japanese else "sp.l")
    return f"""d AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, source || '_' || CAST(doc_id AS VARCHAR) AS label,
         list_transform({para}, lambda p: {tok}) AS ptoks FROM documents),
fl AS (SELECT filename, label, flatten(ptoks) AS flat, list_transform(ptoks, lambda a: CAST(len(a) AS BIGINT)) AS counts FROM d),
fo AS (SELECT filename, label, flat, {fold} AS f FROM fl),
sp AS (SELECT filename, label, flat, {spans} AS spans FROM fo),
ch AS (SELECT filename, label, flat, unnest(spans) AS sp, generate_subscripts(spans, 1) - 1 AS raw_ix FROM sp),
kept AS (SELECT filename, label, array_to_string(flat[sp.s + 1:sp.s + sp.l], '{sep}') AS text, {ntok} AS n_tokens, raw_ix
         FROM ch),
kept2 AS (SELECT * FROM kept WHERE n_tokens >= {s.min_chunksize}),
chunks AS (
  SELECT CAST(row_number() OVER (ORDER BY filename, raw_ix) - 1 AS BIGINT) AS docid, filename, label,
         CAST(row_number() OVER (PARTITION BY filename ORDER BY raw_ix) - 1 AS INTEGER) AS chunk_ix,
         text, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(length(text) AS INTEGER) AS length
  FROM kept2)"""


def _out(df):
    return df.select("docid", "filename", "label", "chunk_ix", "n_tokens", "length", F.md5("text").alias("text_md5"))


SQL_OUT = "SELECT docid, filename, label, chunk_ix, n_tokens, length, md5(text) AS text_md5 FROM chunks"


@query("chunk_paragraphs", with_ctes(sql_chunks(FAST)) + "\n" + SQL_OUT)
def q_chunk_paragraphs(spark, sf):
    """Paragraph packing of every document into chunks of at most 100 tokens."""
    return _out(_chunks(spark, sf, FAST))


@query("chunk_limit", with_ctes(sql_chunks(LIMIT)) + "\n" + SQL_OUT)
def q_chunk_limit(spark, sf):
    """C4: at most 3 chunks per document."""
    return _out(_chunks(spark, sf, LIMIT))


@query("chunk_min_filter", with_ctes(sql_chunks(MINIMUM)) + "\n" + SQL_OUT)
def q_chunk_min_filter(spark, sf):
    """Chunks of 250 tokens, those under 100 tokens dropped."""
    return _out(_chunks(spark, sf, MINIMUM))


@query("chunk_paragraphs_ja", with_ctes(sql_chunks(JA_FAST, japanese=True)) + "\n" + SQL_OUT)
def q_chunk_paragraphs_ja(spark, sf):
    """C1/C5 Japanese path: katakana sentences to hiragana, script tokens, joined without spaces,
    minimum size checked on the re-tokenized chunk."""
    return _out(_chunks(spark, sf, JA_FAST, japanese=True))


@query("docid_assign", with_ctes(sql_chunks(FULL)) + "\nSELECT docid, filename, chunk_ix FROM chunks")
def q_docid_assign(spark, sf):
    """Docid 0..n-1 over all chunks in filename, chunk order."""
    return _chunks(spark, sf, FULL).select("docid", "filename", "chunk_ix")


@query("chunk_length", with_ctes(sql_chunks(FAST)) + "\nSELECT docid, length, n_tokens FROM chunks")
def q_chunk_length(spark, sf):
    """Characters and tokens of every chunk."""
    return _chunks(spark, sf, FAST).select("docid", "length", "n_tokens")


@query("validate_chunking", with_ctes(sql_chunks(FAST)) + """
SELECT CAST(count(*) AS BIGINT) AS n_chunks, count(*) > 0 AS produced, CAST(count(DISTINCT filename) AS BIGINT) AS n_files,
       CAST(max(n_tokens) AS INTEGER) AS longest FROM chunks""")
def q_validate_chunking(spark, sf):
    """The settings are checked (min < max), then the result: chunks, files with chunks, longest chunk."""
    CH.validate_chunking(FAST.chunksize, FAST.min_chunksize)
    ch = _chunks(spark, sf, FAST)
    return ch.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("filename").alias("n_files"), F.max("n_tokens").alias("longest")).select(
        "n_chunks", (F.col("n_chunks") > 0).alias("produced"), "n_files", "longest")


def _sql_sentence_chunks(c: int) -> str:
    text = f"translate(lower(text), '{fx.KANA_FROM}', '{fx.KANA_TO}')"
    sents = f"regexp_split_to_array(replace(replace({text}, '。', '。' || chr(10)), chr(10) || chr(10), chr(10)), '{T.LINE_BREAK}')"
    tagged = "list_filter(" + TG.sql_tagger("s") + ", lambda t: t.pos1 <> '空白')"
    fold = f"""list_reduce(counts, lambda acc, n: CASE WHEN acc.pl + n >= {c}
        THEN {{'off': acc.off + n, 'ps': acc.off + n, 'pl': CAST(0 AS BIGINT), 'out': list_append(acc.out, {{'s': acc.ps, 'l': acc.pl + n}})}}
        ELSE {{'off': acc.off + n, 'ps': acc.ps, 'pl': acc.pl + n, 'out': acc.out}} END,
      {{'off': CAST(0 AS BIGINT), 'ps': CAST(0 AS BIGINT), 'pl': CAST(0 AS BIGINT), 'out': CAST([] AS STRUCT(s BIGINT, l BIGINT)[])}})"""
    return f"""d AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) AS stem, 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
                  list_transform({sents}, lambda s: {tagged}) AS st FROM documents),
fl AS (SELECT stem, filename, flatten(st) AS flat, list_transform(st, lambda a: CAST(len(a) AS BIGINT)) AS counts FROM d),
fo AS (SELECT stem, filename, flat, {fold} AS f FROM fl),
sp AS (SELECT stem, filename, flat, list_concat(f.out, CASE WHEN f.pl > 0 THEN [{{'s': f.ps, 'l': f.pl}}] ELSE [] END) AS spans FROM fo),
ch AS (SELECT stem, filename, flat, unnest(spans) AS sp, generate_subscripts(spans, 1) - 1 AS chunk_ix FROM sp),
v AS (SELECT filename, stem || '_' || CAST(chunk_ix AS VARCHAR) AS label, CAST(chunk_ix AS INTEGER) AS chunk_ix,
             list_transform(flat[sp.s + 1:sp.s + sp.l], lambda t: CASE WHEN t.pos2 = '固有名詞' THEN '' ELSE coalesce(nullif(t.lemma, ''), t.orth) END) AS lemmas,
             list_transform(flat[sp.s + 1:sp.s + sp.l], lambda t: t.orth) AS surfaces FROM ch)"""


@query("chunk_sentences", with_ctes(_sql_sentence_chunks(SENTENCE_CHUNK)) + """
SELECT filename, label, chunk_ix, CAST(len(lemmas) AS INTEGER) AS length, md5(array_to_string(surfaces, '|')) AS surfaces_md5 FROM v""")
def q_chunk_sentences(spark, sf):
    """Whole sentences of tagged tokens until a chunk has >= 200 tokens; the rest is the last chunk."""
    ch = CH.chunk_sentences(_docs(spark, sf, japanese=True), SENTENCE_CHUNK)
    return ch.select("filename", "label", "chunk_ix", "length", F.md5(F.array_join("surfaces", "|")).alias("surfaces_md5"))


@query("chunk_two_views", with_ctes(_sql_sentence_chunks(SENTENCE_CHUNK)) + """
SELECT label, CAST(len(lemmas) AS INTEGER) AS n_lemmas, CAST(len(surfaces) AS INTEGER) AS n_surfaces,
       CAST(len(list_filter(lemmas, lambda x: x = '')) AS BIGINT) AS n_blank,
       md5(array_to_string(lemmas, '|')) AS lemmas_md5 FROM v""")
def q_chunk_two_views(spark, sf):
    """Lemma view (proper nouns blank) and surface view, aligned token by token."""
    ch = CH.chunk_sentences(_docs(spark, sf, japanese=True), SENTENCE_CHUNK)
    return ch.select("label", F.size("lemmas").cast("int").alias("n_lemmas"), F.size("surfaces").cast("int").alias("n_surfaces"),
                     F.size(F.filter("lemmas", lambda x: x == "")).cast("bigint").alias("n_blank"),
                     F.md5(F.array_join("lemmas", "|")).alias("lemmas_md5"))
