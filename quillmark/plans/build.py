"""The whole build of a data set: classify, order, select, cluster, split, check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import labels, text
from quillmark.operators import quality, selection
from quillmark.plans.components import components
from quillmark.plans.staging import staged


def records(raw: DataFrame, key: str = "row_id", path: str = "image_path", nfkc: bool = True) -> DataFrame:
    """Raw benchmark records as rows with their group, labels and text key; an unknown folder is an error."""
    named = raw.withColumn("subcategory", text.subcategory(F.col(path), lenient=False))
    grouped = labels.classify_folders(named, "subcategory")
    dimension = F.broadcast(labels.group_table(raw.sparkSession))
    return grouped.join(dimension, "group").withColumn("sample_id", F.col(key).cast("string")).withColumn("text_key", text.text_key(text.normalize_text(F.col("text"), nfkc)))


def clustered(rows: DataFrame, contents: tuple[str, ...], key: str = "sample_id") -> DataFrame:
    """Adds `cluster`, the least id of all rows that shared contents link, however indirectly; blanks link nothing.

    Contents and clusters are as many as rows: they are merged, never broadcast.
    """

    def edges(c: str) -> DataFrame:
        own = rows.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.col(c).alias("_c"), F.col(key).alias("a"))
        return own.groupBy("_c").agg(F.min("a").alias("b")).hint("merge").join(own, "_c").select("a", "b")

    every = None
    for c in contents:
        every = edges(c) if every is None else every.unionByName(edges(c))
    found = components(every, "a", "b")
    return rows.join(found.hint("merge"), rows[key] == found["node"], "left").withColumn("cluster", F.coalesce("component", key)).drop("node", "component")


def build_dataset(candidates: DataFrame, seed: int = 42, balance: str = "equal_scenarios", target: int | None = None, priority: tuple[str, ...] | None = None, fractions: dict[str, float] | None = None, contents: tuple[str, ...] = ("text_key", "image_key", "image_dhash"), tolerance: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """(data set, report of its checks) from candidates with sample_id, group, scenario, label_binary, source, text_key and image_key."""
    chosen = selection.select_balanced(candidates, "group", "text_key", "image_key", "sample_id", "source", seed, balance, target, priority)
    linked = staged(clustered(chosen, tuple(c for c in contents if c in chosen.columns)), "clustered")
    split = staged(selection.split_clusters(linked, "cluster", "group", fractions, seed), "data-set")
    return split, quality.verified(split, balance=balance, contents=("text_key", "image_key"), tolerance=tolerance)


def topped_up(base: DataFrame, candidates: DataFrame, needed: int, source: str = "subcategory", key: str = "sample_id", seed: int = 7) -> DataFrame:
    """The base with `needed` more rows, one of each source in turn; columns that one side lacks are null. Too few is an error."""
    ordered = selection.round_robin(candidates, source, key, seed).orderBy("turn", source).limit(needed).drop("turn")
    added = staged(ordered, "top-up")
    if added.count() < needed:
        raise ValueError(f"{needed} rows are needed, {added.count()} are there")
    return base.unionByName(added.withColumn("split", F.lit("train")), allowMissingColumns=True)
