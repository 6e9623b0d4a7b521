"""Schema, key and referential checks.

Each check is one aggregate over the input; only the resulting handful of counts
reaches the driver, and only in the ``require_*`` functions that raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.sources.staging import spread


class SchemaError(ValueError):
    """A relation does not match its declared schema or keys."""


def _require_columns(df: DataFrame, schema: T.StructType, name: str) -> None:
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")


def project(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Declared columns in declared order; a value that does not cast becomes NULL."""
    _require_columns(df, schema, name)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def violations(
    df: DataFrame, schema: T.StructType, name: str, *, key: Sequence[str] = (), non_null: Sequence[str] = ()
) -> DataFrame:
    """(rule, violations) rows: uncastable values, nulls and surplus rows on the key."""
    _require_columns(df, schema, name)
    cast_counts = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f"cast:{f.name}")
        for f in schema
    ]
    null_counts = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in non_null]
    rules = [f"cast:{f.name}" for f in schema] + [f"null:{c}" for c in non_null]
    out = (
        df.agg(*cast_counts, *null_counts)
        .select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("violations")) for r in rules])).alias("v"))
        .select("v.*")
    )
    if key:
        out = out.unionByName(
            duplicate_rows(df, key).select(F.lit("duplicate:" + ",".join(key)).alias("rule"), F.col("surplus_rows").alias("violations"))
        )
    return out


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key; keys hardly repeat, so rows are dealt by key before they are grouped."""
    return spread(df.select(*key), *key, rows=df.count()).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def validate(
    df: DataFrame, schema: T.StructType, name: str, *, key: Sequence[str] = (), non_null: Sequence[str] = ()
) -> DataFrame:
    """Project to the declared columns, or raise with the first broken rules."""
    broken = violations(df, schema, name, key=key, non_null=non_null).filter("violations > 0").orderBy("rule").collect()
    if broken:
        raise SchemaError(f"{name}: " + ", ".join(f"{r.rule} ({r.violations})" for r in broken))
    return project(df, schema, name)


def count_negative(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column) < 0).alias("negative_rows"))


def unmatched_keys(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct key values of ``df`` that the parent relation lacks."""
    return df.select(key).distinct().join(parent.select(key), key, "left_anti")


def require_no_rows(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise SchemaError(message)


def require_zero(df: DataFrame, message: str) -> None:
    if df.first()[0]:
        raise SchemaError(message)


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Guard for the build side of a many-to-one join; returns the input unchanged."""
    require_zero(duplicate_rows(df, keys), f"{name}: rows repeat on {list(keys)}")
    return df
