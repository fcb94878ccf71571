"""Nulls by type, and selection of features by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "MISSING"


def impute(df: DataFrame, *columns: str) -> DataFrame:
    """Null integers and booleans become 0, floats 0.0, all else ``MISSING`` as text; just the named columns, or all."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def filled(name: str) -> Column:
        kind = kinds[name]
        if isinstance(kind, T.BooleanType):
            return F.coalesce(F.col(name), F.lit(False))
        if isinstance(kind, T.NumericType):
            return F.coalesce(F.col(name), F.lit(0).cast(kind))
        return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))

    return df.withColumns({c: filled(c) for c in columns or df.columns})


def fill_features(features: Column | str, width: int) -> Column:
    """Features, or zeros of the declared width where there are none."""
    features = F.col(features) if isinstance(features, str) else features
    return F.coalesce(features, F.array_repeat(F.lit(0.0).cast("float"), width))


def select_features(features: Column | str, ranges: dict[str, tuple[int, int]], names: list[str]) -> Column:
    """The named parts of a feature array, in the given order; ranges are (start, end) places."""
    features = F.col(features) if isinstance(features, str) else features
    return F.concat(*[F.slice(features, ranges[n][0] + 1, ranges[n][1] - ranges[n][0]) for n in names])


def project(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Rows as a feature spec {name: type} declares them, imputed; a missing column is an error."""
    absent = set(spec) - set(df.columns)
    if absent:
        raise KeyError(f"columns not found: {sorted(absent)}")
    return impute(df.select(*[F.col(c).cast(t).alias(c) for c, t in spec.items()]))


def add_attribute(df: DataFrame, attribute: DataFrame, key: str, name: str, default=None) -> DataFrame:
    """``df`` with an attribute of another table (key, name) as a new column; rows without one get the default. A column of that name is an error."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    value = attribute.select(F.col(key).alias("_key"), F.col(name).alias("_value"))
    out = df.join(value, F.col(key) == F.col("_key"), "left").drop("_key")
    filled = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return out.withColumn(name, filled).drop("_value")


def concat_attributes(features: str, *more: str) -> Column:
    """The feature array with further arrays or numbers behind it, in order, as array<float>; null parts count as nothing, null numbers as 0."""
    none = F.array().cast("array<float>")
    return F.concat(F.coalesce(F.col(features).cast("array<float>"), none), *[F.coalesce(F.col(c).cast("array<float>"), none) for c in more])


def constant_feature(df: DataFrame, name: str = "features", value: float = 1.0, width: int = 1) -> DataFrame:
    """``df`` with the same features in every row, for nodes that have none."""
    return df.withColumn(name, F.array_repeat(F.lit(value).cast("float"), width))
