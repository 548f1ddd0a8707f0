"""Document vectors (E1) and the encoder plug-in point.

Default encoder: TF-IDF weights hashed with signs into ``dims`` dimensions,
L2-normalised.  Per (unit, term): w = n * ln(1 + N / df); the term's
dimension is the first 12 hex digits of md5(term) mod dims, its sign + when
the 13th hex digit is even.  The term statistics (df, N) come from the fitted
corpus and are reused for new texts.

Vocabularies grow with the corpus, so weights can't be sent to every task as a
whole, but most counts are of the most frequent terms: the weights of
``FREQUENT`` terms are broadcast, and a unit's sums over them are made where
its counts are.  Only the counts of all other terms are dealt by term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions.text import once
from topicspark.session import materialize

DIMS = 64
FREQUENT = 200_000  # terms whose weights every task gets, about 10 MB


def term_dim(term_col="term", dims: int = DIMS):
    h = F.md5(F.col(term_col) if isinstance(term_col, str) else term_col)
    dim = F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint"), F.lit(dims)).cast("int")
    sign = F.when(F.conv(F.substring(h, 13, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return dim, sign


def fit_idf(counts: DataFrame, unit: str = "docid") -> DataFrame:
    """(term, df, n_units) of the corpus the encoder is fitted on."""
    n = counts.select(F.countDistinct(unit)).scalar()
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("n_units", n)


def hash_encode(counts: DataFrame, idf: DataFrame, unit: str = "docid", dims: int = DIMS) -> DataFrame:
    """(unit, dim, value) of the normalised hashed TF-IDF vector; zero dims omitted.

    Terms unknown to the fitted ``idf`` are ignored.
    """
    return rows_to_long(hash_rows(counts, idf, unit, dims), unit)


def rows_to_long(rows: DataFrame, unit: str = "docid") -> DataFrame:
    """(unit, vec) of :func:`hash_rows` as (unit, dim, value)."""
    return rows.select(unit, F.posexplode_outer("vec").alias("dim", "value")).where(F.col("value").isNotNull())


def weigh(rows: DataFrame, idf: DataFrame, dims: int = DIMS, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with a column term as (rows..., dim, w) in two tables: those of the most frequent terms, which stay
    where they are, and those of all others (None without any).  w is signed; unknown terms are left out."""
    dim, sign = term_dim("term", dims)
    weights = idf.select("term", "df", dim.alias("dim"), (F.log(F.lit(1.0) + F.col("n_units") / F.col("df")) * sign).alias("w"))
    # one row for each df that some term has, at most ``frequent`` of them
    least, terms = 0, 0
    for r in idf.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).limit(frequent + 1).collect():
        terms += r["n"]
        if terms > frequent:
            least = r["df"] + 1
            break
    often = F.broadcast(weights.where(F.col("df") >= least).drop("df"))
    if least == 0:
        return rows.join(often, "term"), None
    others = rows.join(often.select("term"), "term", "left_anti")
    return rows.join(often, "term"), others.join(weights.where(F.col("df") < least).drop("df"), "term")


def hash_rows(counts: DataFrame, idf: DataFrame, unit: str = "docid", dims: int = DIMS, frequent: int = FREQUENT) -> DataFrame:
    """E1 in rows: (unit, vec array<double> of length 1), null in dims that no term of the unit falls into.

    Units with a sum other than 0, each once.
    """
    often, rare = weigh(counts.where(F.col(unit).isNotNull()).select(unit, "term", "n"), idf, dims, frequent)
    each = F.col("n") * F.col("w")
    sums = often.groupBy(unit).agg(*[F.sum(F.when(F.col("dim") == i, each)).alias(f"_{i}") for i in range(dims)])
    sums = sums.select(unit, F.array(*[F.col(f"_{i}") for i in range(dims)]).alias("_raw"))
    raw = F.col("_raw")
    if rare is not None:
        few = rare.groupBy(unit).agg(F.collect_list(F.struct("dim", each.alias("w"))).alias("_few"))
        sums = sums.join(few, unit, "full")

        def added(i):
            here, before = F.filter("_few", lambda r: r["dim"] == i), F.get(F.col("_raw"), i)
            return once(here, lambda h: F.when(F.size(h) > 0, F.aggregate(h, F.coalesce(before, F.lit(0.0)), lambda acc, r: acc + r["w"])).otherwise(before))

        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), added)

    def scaled(v):
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.coalesce(x * x, F.lit(0.0))))
        return once(length, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))

    # exploded, so that vectors aren't made again for the condition
    return sums.select(unit, F.explode_outer(F.array(once(raw, scaled))).alias("vec")).where(F.col("vec").isNotNull())


def hash_windows(tokens: DataFrame, idf: DataFrame, unit_cols, size: int, dims: int = DIMS, frequent: int = FREQUENT) -> DataFrame:
    """E1 of token windows, a row a unit: (unit..., entries array<struct<lo, hi, dim, w>>).

    The vector of window i, before it is scaled, is the sum of w in dim over the
    entries with lo <= i <= hi.  A token is sent to its unit once, with the
    windows that hold it, not once a window.  Rows that share a unit have their
    windows in common; their entries are summed by window and dim first.  Units
    with a null and terms unknown to the fitted ``idf`` are left out.
    """
    from topicspark.operators.vectorize import split_shared
    units = [unit_cols] if isinstance(unit_cols, str) else list(unit_cols)
    given = tokens.select(*units, "tokens", F.size("tokens").alias("_m")).dropna(subset=units)
    alone, several = split_shared(given, units)
    rows = alone.withColumn("_several", F.lit(False))
    if several is not None:
        rows = rows.unionByName(several.withColumn("_several", F.lit(True)))
    pos = rows.select(*units, "_several", "_m", F.posexplode_outer("tokens").alias("pos", "term"))  # no position has no window
    last = F.greatest(F.col("_m") - size, F.lit(0))
    lo, hi = F.greatest(F.lit(0), F.col("pos") - size + 1), F.least(F.col("pos"), last)
    often, rare = weigh(pos.select(*units, "_several", "term", lo.alias("lo"), hi.alias("hi")).where(F.col("lo") <= F.col("hi")), idf, dims, frequent)
    columns = [*units, "_several", "lo", "hi", "dim", "w"]
    weighed = often.select(columns) if rare is None else often.select(columns).unionAll(rare.select(columns))
    entries = weighed.where(~F.col("_several")).drop("_several")
    if several is not None:
        wins = weighed.where("_several").select(*units, F.explode(F.sequence("lo", "hi")).alias("lo"), "dim", "w")
        entries = entries.unionAll(wins.groupBy(*units, "lo", "dim").agg(F.sum("w").alias("w")).select(*units, "lo", F.col("lo").alias("hi"), "dim", "w"))
    return entries.groupBy(*units).agg(F.collect_list(F.struct("lo", "hi", "dim", "w")).alias("entries"))


def rows_to_dense(rows: DataFrame, unit: str = "docid", dims: int = DIMS, out: str = "embedding", units: DataFrame | None = None) -> DataFrame:
    """(unit, vec) of :func:`hash_rows` -> (unit, array<double>), missing dims 0; as in :func:`to_dense` with ``units``."""
    if units is not None:
        rows = units.select(unit).join(rows, unit, "left")
    zero = F.array(*[F.lit(0.0)] * dims)
    return rows.select(unit, F.coalesce(F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0))), zero).alias(out))


def to_dense(long: DataFrame, unit: str = "docid", dims: int = DIMS, out: str = "embedding", units: DataFrame | None = None) -> DataFrame:
    """(unit, dim, value) -> (unit, array<double> of length dims), missing dims 0.

    A text without a known term has no row in ``long``; given the table of all
    ``units`` (each once), such a unit gets the zero vector.
    """
    per = long.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    if units is not None:
        per = units.select(unit).join(per, unit, "left")
    return per.select(unit, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                        lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)).cast("double")).alias(out))


def to_long(dense: DataFrame, unit: str = "docid", col: str = "embedding") -> DataFrame:
    return dense.select(unit, F.posexplode(col).alias("dim", "value")).select(unit, F.col("dim").cast("int"), F.col("value").cast("double"))


_ENCODERS: dict[str, Callable] = {}


def register_encoder(name: str, fn: Callable) -> None:
    """An encoder maps (unit, text) to (unit, embedding array<float>).

    A neural encoder should be an Iterator pandas_udf so that its model loads
    once per task and texts go through it in Arrow batches.
    """
    _ENCODERS[name] = fn


def encoder(name: str) -> Callable:
    return _ENCODERS[name]


def has_encoder(name: str) -> bool:
    return name in _ENCODERS


def hashed(texts: DataFrame) -> DataFrame:
    """The default encoder: (docid, text) -> (docid, embedding), term statistics from the texts themselves.

    A text without a letter or digit has no row.
    """
    from topicspark.functions import text as T
    from topicspark.operators import vectorize as V
    counts = materialize(V.term_counts(texts.select("docid", T.tokenize_word("text").alias("tokens")), "docid"), "term-counts")
    return rows_to_dense(hash_rows(counts, materialize(fit_idf(counts), "term-idf")))


register_encoder("hashed", hashed)


def with_prefix(text_col, model_name: str, prefix: str = "トピック: "):
    """Prefix the reference adds for one family of Japanese encoders (name contains 'ruri')."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.concat(F.lit(prefix), c) if "ruri" in model_name.lower() else c
