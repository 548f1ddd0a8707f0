"""Chunking (C1-C7).

A document is one row.  Its paragraphs (or sentences) are tokenized with
array functions, the per-paragraph token *counts* are folded with SQL
``aggregate()`` into (start, len) spans over the flattened token array, and
each span is sliced and joined.  Everything happens inside the document's row:
parallel by document, no shuffle, the fold state is a few integers plus the
list of spans.  Only the docid numbering (C7) needs a cross-document step,
done on one small row per file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions import tagging as TG
from topicspark.functions import text as T
from topicspark.operators.numbering import dense_number
from topicspark.session import materialize

SPANS = "array<struct<s:int,l:int>>"


@dataclass(frozen=True)
class ChunkSettings:
    chunksize: int = 100
    min_chunksize: int = 0
    chunks: int = 0              # at most this many chunks per document, 0 = all
    language: str = "English"    # "English" or "Japanese"
    keep_exact_tail: bool = True   # False: lose a long paragraph's last piece of exactly chunksize


def validate_chunking(chunksize: int, min_chunksize: int) -> None:
    """C6 (settings part): the minimum must be below the maximum."""
    if min_chunksize >= chunksize:
        raise ValueError(f"min_chunksize ({min_chunksize}) must be less than chunksize ({chunksize})")


def _span(s, l) -> Column:
    return F.struct(s.cast("int").alias("s"), l.cast("int").alias("l"))


def pack_paragraph_spans(counts: Column, c: int, chunks: int = 0, keep_exact_tail: bool = True) -> Column:
    empty = F.array().cast(SPANS)
    init = F.struct(F.lit(0).alias("off"), F.lit(0).alias("ps"), F.lit(0).alias("pl"),
                    F.lit(0).alias("nc"), empty.alias("out"))
    cl = F.lit(c)

    def step(acc, n):
        off, ps, pl, nc, out = acc["off"], acc["ps"], acc["pl"], acc["nc"], acc["out"]
        k = F.ceil(n / cl).cast("int")                      # pieces of a long paragraph
        last = n - (k - 1) * cl
        closed_p = F.when(pl > 0, F.array(_span(ps, pl))).otherwise(empty)
        pieces = F.when(k >= 2, F.transform(F.sequence(F.lit(0), k - 2), lambda j: _span(off + j * cl, cl))).otherwise(empty)
        keep_last = (last < cl) | F.lit(keep_exact_tail)
        long_par = F.struct(
            (off + n).alias("off"),
            (off + (k - 1) * cl).alias("ps"),
            F.when(keep_last, last).otherwise(F.lit(0)).alias("pl"),
            (nc + F.when(pl > 0, 1).otherwise(0) + (k - 1)).alias("nc"),
            F.concat(out, closed_p, pieces).alias("out"))
        overflow = F.struct((off + n).alias("off"), off.alias("ps"), n.alias("pl"), (nc + 1).alias("nc"),
                            F.concat(out, F.array(_span(ps, pl))).alias("out"))
        append = F.struct((off + n).alias("off"), F.when(pl == 0, off).otherwise(ps).alias("ps"),
                          (pl + n).alias("pl"), nc.alias("nc"), out.alias("out"))
        stopped = F.lit(chunks > 0) & (nc >= F.lit(chunks))
        return (F.when(stopped, acc).when(n >= cl, long_par)
                .when(n + pl > cl, overflow).otherwise(append))

    def finish(acc):
        spans = F.concat(acc["out"], F.when(acc["pl"] > 0, F.array(_span(acc["ps"], acc["pl"]))).otherwise(empty))
        return F.slice(spans, 1, chunks) if chunks > 0 else spans

    return F.aggregate(counts, init, step, finish)


def pack_sentence_spans(counts: Column, c: int, keep_tail: bool = True) -> Column:
    """C2 fold: add whole sentences until the chunk has >= c tokens; the unfinished rest is a last chunk, or dropped."""
    empty = F.array().cast(SPANS)
    init = F.struct(F.lit(0).alias("off"), F.lit(0).alias("ps"), F.lit(0).alias("pl"), empty.alias("out"))

    def step(acc, n):
        off, ps, pl, out = acc["off"], acc["ps"], acc["pl"], acc["out"]
        full = pl + n >= F.lit(c)
        return F.struct((off + n).alias("off"),
                        F.when(full, off + n).otherwise(ps).alias("ps"),
                        F.when(full, F.lit(0)).otherwise(pl + n).alias("pl"),
                        F.when(full, F.concat(out, F.array(_span(ps, pl + n)))).otherwise(out).alias("out"))

    def finish(acc):
        tail = F.when((acc["pl"] > 0) & F.lit(keep_tail), F.array(_span(acc["ps"], acc["pl"]))).otherwise(empty)
        return F.concat(acc["out"], tail)

    return F.aggregate(counts, init, step, finish)


def _paragraph_tokens(settings: ChunkSettings, tokenizer=None):
    if settings.language == "Japanese":
        tok = tokenizer or T.script_tokens_ja
        prep = T.kata2hira_if_katakana_sentence
    else:
        tok = tokenizer or T.tokenize_ws
        prep = None
    return tok, prep


def chunk_paragraphs(docs: DataFrame, settings: ChunkSettings, tokenizer=None) -> DataFrame:
    """Chunks of every document.

    ``docs`` has (filename, title, text) and any other per-document columns,
    which are carried along.  Returns one row per chunk with
    (docid, filename, label, chunk_ix, text, n_tokens, length).
    """
    validate_chunking(settings.chunksize, settings.min_chunksize)
    tok, prep = _paragraph_tokens(settings, tokenizer)
    sep = "" if settings.language == "Japanese" else " "
    extra = [c for c in docs.columns if c not in ("filename", "title", "text")]
    paras = T.paragraphs("text")
    if prep is not None:
        paras = F.transform(paras, prep)
    step1 = docs.select(*extra, "filename", "title", F.transform(paras, tok).alias("_ptoks"))
    step2 = step1.select(*extra, "filename", "title", F.flatten("_ptoks").alias("_flat"),
                         F.transform("_ptoks", lambda a: F.size(a)).alias("_counts"))
    spans = pack_paragraph_spans(F.col("_counts"), settings.chunksize, settings.chunks, settings.keep_exact_tail)
    step3 = step2.select(*extra, "filename", "title", "_flat", spans.alias("_spans"))
    texts = F.transform("_spans", lambda x: F.struct(
        F.array_join(F.slice("_flat", x["s"] + 1, x["l"]), sep).alias("text"), x["l"].alias("n_tokens")))
    # _flat is used inside the lambda; a second reference outside it keeps the
    # optimizer from inlining (re-flattening) the array once per chunk
    texts = F.when(F.size("_flat") >= 0, texts)
    step4 = step3.select(*extra, "filename", "title", texts.alias("_chunks"))
    if settings.language == "Japanese":
        # Japanese re-tokenizes the joined chunk, so the count may change
        step4 = step4.select(*extra, "filename", "title", F.transform("_chunks", lambda ch: F.struct(
            ch["text"].alias("text"), F.size(tok(ch["text"])).alias("n_tokens"))).alias("_chunks"))
    kept = F.filter("_chunks", lambda ch: ch["n_tokens"] >= F.lit(settings.min_chunksize))
    per_doc = step4.select(*extra, "filename", "title", kept.alias("_chunks")).withColumn("_n", F.size("_chunks"))
    return assign_docids(per_doc)


def assign_docids(per_doc: DataFrame) -> DataFrame:
    """Docid 0..n-1 over all chunks, in filename then chunk order.

    The per-document chunk arrays are written once to the shared folder; the
    offsets come from a distributed prefix sum over one small row per file
    (only the filename and count columns are read back), then join back on
    filename (AQE broadcasts the offsets when they are small).
    """
    # filter after the write: pushed into the Parquet scan instead of
    # duplicating the chunking expressions in a pushed-down predicate
    per_doc = materialize(per_doc, "chunks").where(F.col("_n") > 0)
    offs = dense_number(per_doc.select("filename", "_n"), "filename", "_off", weight_col="_n")
    out = per_doc.join(offs.select("filename", "_off"), "filename")
    out = out.select("*", F.posexplode("_chunks").alias("chunk_ix", "_ch"))
    extra = [c for c in per_doc.columns if c not in ("filename", "title", "_chunks", "_n")]
    return out.select(
        (F.col("_off") + F.col("chunk_ix")).cast("bigint").alias("docid"),
        "filename", F.col("title").alias("label"), F.col("chunk_ix").cast("int").alias("chunk_ix"),
        F.col("_ch.text").alias("text"), F.col("_ch.n_tokens").cast("int").alias("n_tokens"),
        F.length(F.col("_ch.text")).cast("int").alias("length"), *extra)


def chunk_sentences(docs: DataFrame, chunk_size: int = 2000, tagger=None, keep_tail: bool = True) -> DataFrame:
    """C2 + C3: sentence chunks of tagged tokens in two aligned views.

    ``lemmas``: lemma (surface if unknown) with proper nouns blanked to '';
    ``surfaces``: surface forms.  Both views have one entry per token, so one
    fold on the counts gives the spans of both.  Label = '<stem>_<k>'.
    The unfinished rest of a document is its last chunk unless ``keep_tail``
    is off.  Returns (filename, label, chunk_ix, lemmas, surfaces, length).
    """
    tg = tagger or TG.default_tagger
    sents = T.sentences_ja("text")
    tagged = F.transform(sents, lambda s: F.filter(tg(s), lambda t: t["pos1"] != F.lit("空白")))
    step1 = docs.select("filename", "title", tagged.alias("_st"))
    step2 = step1.select("filename", "title", F.flatten("_st").alias("_flat"),
                         F.transform("_st", lambda a: F.size(a)).alias("_counts"))
    step3 = step2.select("filename", "title", "_flat", pack_sentence_spans(F.col("_counts"), chunk_size, keep_tail).alias("_spans"))
    views = F.transform("_spans", lambda x: F.struct(
        T.proper_noun_blank(F.slice("_flat", x["s"] + 1, x["l"])).alias("lemmas"),
        F.transform(F.slice("_flat", x["s"] + 1, x["l"]), lambda t: t["orth"]).alias("surfaces")))
    out = step3.select("filename", "title", F.posexplode(views).alias("chunk_ix", "_v"))
    return out.select("filename",
                      F.concat_ws("_", F.regexp_replace("filename", r"\.[^.]*$", ""), F.col("chunk_ix").cast("string")).alias("label"),
                      F.col("chunk_ix").cast("int").alias("chunk_ix"), F.col("_v.lemmas").alias("lemmas"),
                      F.col("_v.surfaces").alias("surfaces"), F.size("_v.lemmas").cast("int").alias("length"))


def check_not_empty(chunks: DataFrame) -> None:
    """C6 (result part): error when chunking produced nothing (one-row probe)."""
    if chunks.limit(1).count() == 0:
        raise ValueError("No document chunks were produced; check the input files and the chunking settings.")
