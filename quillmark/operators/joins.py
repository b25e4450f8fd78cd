"""Joins by key, with the checks that make them safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_by(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) by `order`. Whole rows are reduced map-side, none is gathered."""
    row = F.struct(*df.columns)
    pick = F.max_by(row, F.col(order)) if last else F.min_by(row, F.col(order))
    return df.groupBy(F.col(key).alias("_key")).agg(pick.alias("r")).select("r.*")


def aligned(features: DataFrame, rows: DataFrame, key: str = "sample_id", strict: bool = True) -> DataFrame:
    """1:1 join. Strict: every feature row must find its row, else it is an error."""
    if not strict:
        return features.join(rows, key)
    marked = features.join(rows.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return marked.where(checked).drop("_found")


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem): ids on one side alone, and columns that differ. Empty if the tables agree."""
    a = left.select(F.col(key), F.lit(1).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    b = right.select(F.col(key), F.lit(1).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    problem = F.when(F.col("_a").isNull(), F.lit("only right")).when(F.col("_b").isNull(), F.lit("only left"))
    for c in columns:
        problem = problem.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c))
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def concatenated(tables: list[DataFrame], key: str = "sample_id", features: str = "features", agree: tuple[str, ...] = ("label", "split")) -> DataFrame:
    """Feature arrays of all tables side by side; a row whose `agree` columns differ is an error."""
    first = tables[0].select(key, *agree, F.col(features).alias("_f0"))

    def add(acc: DataFrame, item: tuple[int, DataFrame]) -> DataFrame:
        k, df = item
        joined = acc.join(df.select(key, *(F.col(c).alias(f"_{c}") for c in agree), F.col(features).alias(f"_f{k}")), key)
        same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), agree, F.lit(True))
        return joined.where(F.when(~same, F.raise_error(F.concat(F.lit("labels differ at "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop(*(f"_{c}" for c in agree))

    out = reduce(add, enumerate(tables[1:], 1), first)
    return out.select(key, *agree, F.concat(*(F.col(f"_f{k}") for k in range(len(tables)))).alias(features))


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def exclusion_reason(rows: DataFrame, protected: dict[str, tuple[DataFrame, str, str]], empty: Column | None = None) -> DataFrame:
    """Adds `reason`, null for rows to keep: one left join for each key, in order of precedence.

    `protected` maps a reason to (table of protected values, its column, the column of `rows`). A single OR
    of keys would be a nested loop. `empty` marks rows excluded as `empty_caption` after the first reason.
    """
    out, marks = rows, []
    for k, (reason, (table, theirs, own)) in enumerate(protected.items()):
        keys = table.select(F.col(theirs).alias(f"_k{k}")).where(F.col(f"_k{k}").isNotNull()).distinct().withColumn(f"_m{k}", F.lit(True))
        out = out.join(keys, F.col(own) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        marks.append((reason, F.col(f"_m{k}").isNotNull()))
    if empty is not None:
        marks.insert(1, ("empty_caption", empty))
    reason = F.coalesce(*(F.when(m, F.lit(r)) for r, m in marks))
    return out.withColumn("reason", reason).drop(*(f"_m{k}" for k in range(len(protected))))


def one_of(rows: DataFrame, key: str, agree: list[str], kept: list[str], order: str) -> DataFrame:
    """1:N back to one row a key: `agree` columns must have one value, `kept` come from the first row by `order`."""
    first = [F.min_by(c, order).alias(c) for c in kept]
    same = [F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit(f"{c} differs")).cast(rows.schema[c].dataType)).alias(c) for c in agree]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *same, *first)


def resolved(paths: DataFrame, listing: DataFrame, candidates: list[Column], key: str) -> DataFrame:
    """(key, path, exists): the first candidate that is in `listing` (column path), else the first one."""
    tried = paths.select(key, F.posexplode(F.array(*candidates)).alias("at", "path"))
    there = tried.join(listing.select("path").distinct().withColumn("exists", F.lit(True)), "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    order = F.struct((~F.col("exists")).cast("int"), "at")
    return there.groupBy(key).agg(F.min_by(F.struct("path", "exists"), order).alias("r")).select(key, "r.*")
