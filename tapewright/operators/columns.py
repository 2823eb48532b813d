"""Column-set operators: keep lists, required columns, renames, coercion, guards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.measures import number


def keep_listed(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Listed columns that exist, in list order."""
    return df.select(*[c for c in columns if c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of ``schema``; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def to_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in columns})


def zero_fill(df: DataFrame) -> DataFrame:
    """Null measures count as 0."""
    return df.fillna(0)


def drop_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def forbid_outcomes(df: DataFrame) -> DataFrame:
    """Refuse a table that carries an outcome column."""
    leaked = [c for c in df.columns if "fwd" in c or "outcome" in c]
    if leaked:
        raise ValueError(f"outcome columns in a feature table: {', '.join(leaked)}")
    return df


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; a column some frames lack is null there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
