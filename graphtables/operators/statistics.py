"""Aggregates over features, embeddings and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .enumeration import number_rows


def pooled_clip(df: DataFrame, features: str, low: float = 0.005, high: float = 0.995, accuracy: int = 10_000) -> DataFrame:
    """(clip_min, clip_max): approximate quantiles of all values of all features together; an empty range is widened by 1e-5."""
    q = df.select(F.explode(features).alias("x")).agg(F.percentile_approx("x", [low, high], accuracy).alias("q"))
    return q.select(F.col("q")[0].cast("double").alias("clip_min"), F.when(F.col("q")[1] <= F.col("q")[0], F.col("q")[0] + 1e-5).otherwise(F.col("q")[1]).cast("double").alias("clip_max"))


def sign_means(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Means of the values up to 0 and of those above, 0.0 where there are none."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0)).alias("neg_mean"), F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("pos_mean"))


PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def quantiles(df: DataFrame, value: str, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """One row of exact interpolated quantiles p1 ...: values are numbered in range partitions, and only those at the wanted places meet."""
    numbered = number_rows(df.select(F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL"), "_x", out="_at")
    size = F.broadcast(numbered.agg(F.count("*").alias("_n")))  # one row
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    ends = F.array(*[f(place(p)).cast("long") for p in percentiles for f in (F.floor, F.ceil)])
    few = numbered.join(size).where(F.array_contains(ends, F.col("_at")))
    at = lambda k: F.max(F.when(F.col("_at") == k, F.col("_x")))
    low = {p: at(F.floor(place(p))) for p in percentiles}
    high = {p: at(F.ceil(place(p))) for p in percentiles}
    rest = {p: F.max(place(p) - F.floor(place(p))) for p in percentiles}
    return few.agg(*[(low[p] + (high[p] - low[p]) * rest[p]).alias(f"p{round(p * 100)}") for p in percentiles])


def describe(df: DataFrame, value: str, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """count, mean, std, min, exact percentiles p1 ..., max."""
    plain = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    both = plain.join(F.broadcast(quantiles(df, value, percentiles)))  # one row each
    return both.select("count", "mean", "std", "min", *[f"p{round(p * 100)}" for p in percentiles], "max")


def assert_threshold(df: DataFrame, column: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """The same rows; a value of ``column`` below ``least`` or above ``most`` (or none) fails the query that reads them."""
    ok = F.col(column).isNotNull()
    if least is not None:
        ok = ok & (F.col(column) >= least)
    if most is not None:
        ok = ok & (F.col(column) <= most)
    bad = F.raise_error(F.concat(F.lit(f"{column} beyond its threshold: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return df.withColumn(column, F.when(F.coalesce(ok, F.lit(False)), F.col(column)).otherwise(bad.cast(df.schema[column].dataType)))


def dataset_statistics(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n, missing, distinct, mean, std, least, most) of each column, the last four of numbers only; one pass, distinct counts
    approximate."""
    names = columns or tuple(df.columns)
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).cast("double") if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else F.lit(None).cast("double")
    per = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.approx_count_distinct(c).alias("distinct"), F.avg(number(c)).alias("mean"), F.stddev_samp(number(c)).alias("std"), F.min(number(c)).alias("least"), F.max(number(c)).alias("most")) for c in names]
    return df.agg(F.array(*per).alias("x")).select(F.inline("x"))


def embedding_drift(a: DataFrame, b: DataFrame, key: str = "node_id", embedding: str = "emb") -> DataFrame:
    """(key, cosine): similarity of each node's embeddings in two tables."""
    other = b.select(F.col(key), F.col(embedding).alias("_other"))
    return a.join(other, key).select(key, cosine(embedding, "_other").alias("cosine"))


def ranking_metrics(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10), ties: str = "optimistic") -> DataFrame:
    """(query, hit@k..., mrr) over positives of (query, positive boolean, score): a positive's rank is 1 + the negatives above it (or, with
    ``pessimistic`` ties, at least as high). One window over each query's scores; no pairs are made."""
    negative = (~F.col("positive")).cast("long")
    upto = Window.partitionBy("query").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.sum(negative).over(upto)
    if ties == "optimistic":
        above = above - F.sum(negative).over(Window.partitionBy("query", "score"))
    ranked = scores.select("query", "positive", "score").withColumn("rank", 1 + above).where("positive")
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"hit_at_{k}") for k in ks]
    return ranked.groupBy("query").agg(*hits, F.avg(1.0 / F.col("rank")).alias("mrr"))


def mean_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(F.when(F.col("positive"), F.col("score"))).alias("positive_mean"), F.avg(F.when(~F.col("positive"), F.col("score"))).alias("negative_mean"))


def bpr_loss(scores: DataFrame) -> DataFrame:
    """Mean of -log sigmoid(positive - negative) over (positive_score, negative_score), without overflow."""
    x = F.col("positive_score") - F.col("negative_score")
    return scores.agg(F.avg(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias("bpr"))


def count_min(df: DataFrame, column: str, depth: int = 5, width: int = 2048, seed: int = 7) -> DataFrame:
    """(row, cell, n): a count-min sketch of a column's values, as rows of its cells that hold something. Sketches merge by sums of n."""
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), slot_of(column, i, seed, width).alias("cell"))))
    return df.where(F.col(column).isNotNull()).select(cells.alias("x")).groupBy("x.row", "x.cell").agg(F.count("*").alias("n"))


def slot_of(column: str, row: Column, seed: int, width: int) -> Column:
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.col(column).cast("string")))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % width


def count_min_estimate(sketch: DataFrame, values: DataFrame, column: str, depth: int = 5, width: int = 2048, seed: int = 7) -> DataFrame:
    """(column, estimate): for each distinct value the least of its cells, never less than its true count."""
    asked = values.select(column).where(F.col(column).isNotNull()).distinct()
    rows = asked.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    met = rows.withColumn("cell", slot_of(column, F.col("row"), seed, width)).join(sketch, ["row", "cell"], "left")
    return met.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def in_batch_probability(df: DataFrame, column: str, batch: int) -> DataFrame:
    """(column, frequency, probability): the chance min(1, batch * frequency / total) that a value is in a batch."""
    counts = df.groupBy(column).agg(F.count("*").alias("frequency"))
    total = df.agg(F.count(column).alias("_total"))
    return counts.join(F.broadcast(total)).select(column, "frequency", F.least(F.lit(1.0), batch * F.col("frequency") / F.col("_total")).alias("probability"))


def vocabulary(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(column, n): values by falling frequency, then value."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out if most is None else out.limit(most)


def scale_columns(df: DataFrame, *columns: str, how: str = "minmax") -> DataFrame:
    """Columns scaled by statistics of the whole table: ``minmax`` to [0, 1], ``zscore``; one pass for all statistics."""
    aggs: list[Column] = []
    for c in columns:
        aggs += [F.min(c).alias(f"_{c}_a"), F.max(c).alias(f"_{c}_b")] if how == "minmax" else [F.avg(c).alias(f"_{c}_a"), F.stddev_pop(c).alias(f"_{c}_b")]
    met = df.join(F.broadcast(df.agg(*aggs)))
    width = {c: F.col(f"_{c}_b") - F.col(f"_{c}_a") if how == "minmax" else F.col(f"_{c}_b") for c in columns}
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_{c}_a")) / F.nullif(width[c].cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return met.withColumns(scaled).select(*df.columns)
