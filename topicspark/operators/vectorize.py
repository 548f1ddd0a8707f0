"""Vectorizing (V1-V6): term counts, document-frequency limits, vocabularies, bags of words.

All tables are long (unit, term, n); Spark's partial aggregation combines
counts map-side, so a frequent term never ships more than one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions.text import once
from topicspark.session import materialize

LEAST_SHARE = 0.1  # from this max_df on, the terms above it are few: at most the mean terms of a unit / max_df


def explode_terms(df: DataFrame, unit_cols, tokens_col: str = "tokens", term_col: str = "term") -> DataFrame:
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    # the outer form: for the plain one the optimizer adds a condition on the array, which makes the tokens again
    return df.select(*units, F.posexplode_outer(tokens_col).alias("_pos", term_col)).where(F.col("_pos").isNotNull()).drop("_pos")


def term_counts(df: DataFrame, unit_cols, tokens_col: str = "tokens") -> DataFrame:
    """(unit..., term, n): occurrences of each term in each unit.

    A row's terms are counted inside the row.  Only units that several rows
    share are grouped, so the counts of all others are never shuffled.
    """
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    def in_rows(df):
        return df.select(*units, F.explode_outer(counted(tokens_col)).alias("_c")).where(F.col("_c").isNotNull()).select(*units, "_c.term", "_c.n")

    alone, several = split_shared(df, units)
    if several is None:
        return in_rows(alone)
    grouped = explode_terms(several, units, tokens_col).groupBy(*units, "term").agg(F.count(F.lit(1)).alias("n"))
    return in_rows(alone).unionByName(grouped)


def split_shared(df: DataFrame, units: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows that have their unit to themselves, and those of units that several rows share (None without any)."""
    rows = df.groupBy(*units).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    shared = materialize(rows.select(*[F.col(u).alias(f"_shared{i}") for i, u in enumerate(units)]), "shared-units")
    if shared.limit(1).count() == 0:
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(f"_shared{i}")) for i, u in enumerate(units)])
    return df.join(shared, same, "left_anti"), df.join(shared, same, "left_semi")


def counted(tokens) -> Column:
    """array<struct<term, n>>: the distinct tokens of an array with their numbers; null for an empty one."""
    def runs(s):
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return F.when(F.size(s) > 0, once(begins, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(s, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("bigint").alias("n")))))

    return once(F.sort_array(tokens), runs)


def count_vectorize(counts: DataFrame, unit_cols, n_units, max_df: float | int | None = None,
                    min_df: float | int | None = None) -> DataFrame:
    """V1: keep terms whose document frequency (number of units) is within the limits.

    ``n_units`` is a Column (scalar subquery) or a number: the count of units,
    empty ones included.  A float limit is a share of units, an int an absolute
    count (the scikit-learn convention); the kept rows are returned unchanged.
    """
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    n = n_units if not isinstance(n_units, (int, float)) else F.lit(n_units)
    dfreq = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    cond = F.lit(True)
    if max_df is not None:
        hi = F.lit(max_df) if isinstance(max_df, int) else n * F.lit(float(max_df))
        cond = cond & (F.col("df") <= hi)
    if min_df is not None:
        lo = F.lit(min_df) if isinstance(min_df, int) else n * F.lit(float(min_df))
        cond = cond & (F.col("df") >= lo)
    if isinstance(max_df, float) and max_df >= LEAST_SHARE and min_df is None:
        # the few terms that go are sent to every task, instead of dealing all counts by term
        gone = F.broadcast(dfreq.where(~cond).select("term"))
        return counts.where(F.col("term").isNotNull()).join(gone, "term", "left_anti").select(*units, "term", "n")
    keep = dfreq.where(cond).select("term")
    return counts.join(keep, "term", "left_semi").select(*units, "term", "n")


def vocabulary(counts: DataFrame) -> DataFrame:
    """Vocabulary of a count table: (term, df, cf)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def vectorize_fixed_vocab(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """V2: counts restricted to a saved vocabulary; unknown terms are ignored."""
    return counts.join(vocab.select("term"), "term", "left_semi")


def dictionary_extremes(docs_terms: DataFrame, unit_col: str = "docid", no_below: int = 5,
                        no_above: float = 0.5, keep_n: int | None = None, n_units=None) -> DataFrame:
    """V3: terms in at least ``no_below`` units and at most ``no_above`` of all units.

    ``docs_terms`` is (unit, term, n); ``n_units`` the count of units, where
    some have no term (else they are counted from the table).  Optionally keep the ``keep_n`` most
    frequent (by df, then term).  Returns (term, df).
    """
    if n_units is None:
        n_units = docs_terms.select(F.countDistinct(unit_col)).scalar()
    df = docs_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df.where((F.col("df") >= no_below) & (F.col("df") <= n_units * F.lit(float(no_above))))
    if keep_n is not None:
        from topicspark.operators.topk import top_k
        df = top_k(df, [], [F.desc("df"), F.asc("term")], keep_n, salt_col="term").drop("rank")
    return df


def vocab_index(vocab: DataFrame) -> DataFrame:
    """V5: term ids 0..V-1 in term order (dense, distributed prefix numbering)."""
    from topicspark.operators.numbering import dense_number
    return dense_number(vocab, "term", "term_id")


def doc2bow(tokens_long: DataFrame, vocab_ids: DataFrame, unit_col: str = "docid") -> DataFrame:
    """V4: (unit, term_id, n) for in-vocabulary tokens; '' is never a term."""
    counts = tokens_long.where(F.col("term") != F.lit("")).groupBy(unit_col, "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(vocab_ids.select("term", "term_id"), "term").select(unit_col, "term_id", "n")


def validate_vectorizer(token_arrays: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """V6: one row: units, units without tokens, their share, and the verdict."""
    s = token_arrays.agg(
        F.count(F.lit(1)).alias("units"),
        F.sum(F.when(F.coalesce(F.size(tokens_col), F.lit(0)) <= 0, 1).otherwise(0)).cast("bigint").alias("empty_units"),
    )
    return s.select(
        "units", "empty_units",
        F.when(F.col("units") > 0, F.col("empty_units") / F.col("units")).cast("double").alias("empty_share"),
        F.when(F.col("units") == 0, F.lit("no_documents"))
         .when(F.col("empty_units") == F.col("units"), F.lit("fallback_tokenizer"))
         .otherwise(F.lit("ok")).alias("verdict"),
    )
