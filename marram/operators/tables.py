"""Replacing and keeping rows of written tables: upserts, pruning, retention. Each returns the new state; a caller writes it beside
the old one and then names it current, which is all that plain Parquet needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose keys new has none of."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the greatest by order: an aggregate with partial combination, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select(*(F.col(k) if k in keys else F.col(f"r.{k}").alias(k) for k in df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(old.unionByName(new), keys, order)


def prune_missing(index: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return index.join(present.select(key).distinct(), key, "left_semi")


def reconcile(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, state): added, changed, unchanged or vanished, by a full outer join."""
    a, b = old.select(key, F.col(version).alias("__o")), new.select(key, F.col(version).alias("__n"))
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "vanished").when(F.col("__o") == F.col("__n"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def delete_path(df: DataFrame, prefix: str) -> DataFrame:
    """Without a file, or a directory and all below it."""
    return df.where((F.col("path") != prefix) & ~F.col("path").startswith(prefix.rstrip("/") + "/"))


def prune_expired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def keep_newest(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
