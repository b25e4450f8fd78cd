"""Writers: data sets with manifests, feature stores, appended lines, checked round trips, locks.

Nothing is overwritten: writers fail if the target is there. Manifests and locks are small JSON files
written through Spark, so any store will do.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed names: the columns of a data set, in order.
DATASET_COLUMNS = ("sample_id", "source", "source_split", "group", "scenario", "label_index", "label_binary", "text_fake", "image_fake", "ooc", "text", "image_path", "raw_label", "subcategory", "text_source", "image_source", "rule", "split", "cluster", "text_key", "image_key", "image_sha1", "image_dhash", "image_ok")


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order: count, and two sums of row hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)"))).first()
    return ":".join(str(x or 0) for x in r)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_dataset(rows: DataFrame, path: str, columns: tuple[str, ...] = DATASET_COLUMNS, kind: str = "csv") -> dict:
    """The fixed columns, absent ones blank, with a manifest of counts by group, split and source beside them."""
    out = rows.select(*(F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))
    writer = out.write.mode("errorifexists")
    writer.csv(path, header=True, quote='"', escape='"', emptyValue="") if kind == "csv" else writer.parquet(path)
    counts = rows.groupBy("group", "split", "source").count().collect()
    manifest = {"rows": sum(r["count"] for r in counts), "columns": list(columns), "hash": content_hash(out), "counts": [[r["group"], r["split"], r["source"], r["count"]] for r in sorted(counts, key=str)]}
    write_json(rows.sparkSession, manifest, f"{path}.manifest")
    return manifest


def write_features(rows: DataFrame, store: str, encoder: str, dataset: str, condition: str, provenance: dict) -> None:
    """Appends one condition to the feature store, partitioned so that readers open what they ask for."""
    tagged = rows.withColumns({"encoder": F.lit(encoder), "dataset": F.lit(dataset), "condition": F.lit(condition)})
    tagged.write.mode("append").partitionBy("encoder", "dataset", "condition").parquet(store)
    # last, so that no hash stands for rows that a failed write has left out
    write_json(rows.sparkSession, provenance | {"rows_hash": content_hash(rows)}, f"{store}.provenance/{encoder}-{dataset}-{condition}")


def verified_features(spark: SparkSession, store: str, encoder: str, dataset: str, condition: str) -> DataFrame:
    """Rows of one condition of the store, if they are those that its provenance tells of; changed rows are an error."""
    from quillmark.sources.files import feature_rows

    rows = feature_rows(spark, store, encoder, dataset, condition)
    told = read_json(spark, f"{store}.provenance/{encoder}-{dataset}-{condition}")["rows_hash"]
    if content_hash(rows.drop("encoder", "dataset", "condition")) != told:
        raise OSError(f"{encoder}, {dataset}, {condition}: the rows aren't those of the provenance")
    return rows


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rewritten_without(spark: SparkSession, source: str, quarantined: DataFrame, key: str, target: str) -> DataFrame:
    """Lines without quarantined ids, to a new path: a table that is being read is never overwritten."""
    kept = spark.read.json(source).join(quarantined.select(key).distinct(), key, "left_anti")
    kept.write.mode("errorifexists").json(target)
    return spark.read.json(target)


def write_checked(rows: DataFrame, path: str) -> DataFrame:
    """Writes Parquet, reads it back and compares all rows, copies counted."""
    rows.write.mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if not rows.exceptAll(back).isEmpty() or not back.exceptAll(rows).isEmpty():
        raise OSError(f"{path} doesn't hold what was written")
    return back


def wide_predictions(base: DataFrame, heads: dict[str, DataFrame], key: str = "sample_id", digits: int = 6) -> DataFrame:
    """One row an id: truth, probability and prediction of each head. Heads without a row for all ids are left out."""
    n = base.count()
    for name, head in heads.items():
        if head.join(base.select(key), key, "left_semi").count() == n:
            base = base.join(head.select(key, F.col("truth").alias(f"{name}_true"), F.round("prob", digits).alias(f"{name}_prob"), F.col("pred").alias(f"{name}_pred")), key)
    return base


def write_lock(spark: SparkSession, path: str, choices: dict, inputs: dict[str, DataFrame]) -> dict:
    """Choices and the hashes of all inputs, once, before anything is scored on test rows."""
    lock = {"choices": choices, "inputs": {k: content_hash(df) for k, df in inputs.items()}, "test_used_for_selection": False}
    write_json(spark, lock, path)
    return lock


def check_lock(spark: SparkSession, path: str, inputs: dict[str, DataFrame]) -> dict:
    """The lock, if all inputs are as they were and no test row was used."""
    lock = read_json(spark, path)
    if lock.get("test_used_for_selection") is not False:
        raise ValueError("test rows were used for the selection")
    changed = [k for k, df in inputs.items() if lock["inputs"].get(k) != content_hash(df)]
    if changed or set(lock["inputs"]) != set(inputs):
        raise ValueError(f"inputs changed since the lock: {changed}")
    return lock


def matrix_text(rows: list[tuple], row: str = "true", column: str = "predicted") -> str:
    """A small collected table of (row, column, n) as aligned text."""
    names_r, names_c = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    cells = {(r[0], r[1]): r[2] for r in rows}
    table = [[f"{row}\\{column}", *map(str, names_c)], *([str(a), *(str(cells.get((a, b), 0)) for b in names_c)] for a in names_r)]
    widths = [max(len(r[k]) for r in table) for k in range(len(table[0]))]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, widths, strict=True)) for r in table)


def report_lines(rows: DataFrame, row: str, column: str, columns: tuple[str, ...], width: int = 22) -> list[str]:
    """Counts as aligned lines, a line for each value of `row` and a last one of totals: of a selection by source, a split by group, a loaded file by folder.

    `columns` are the values that get a column, in order; rows with another value count in none. Few values of `row` are assumed.
    """
    counts = rows.groupBy(row).pivot(column, list(columns)).count().na.fill(0).orderBy(row).collect()
    lines = [" ".join(["".ljust(width), *(f"{c:>8}" for c in columns)])]
    lines += [" ".join([str(r[row]).ljust(width), *(f"{r[c]:8d}" for c in columns)]) for r in counts]
    return [*lines, " ".join(["total".ljust(width), *(f"{sum(r[c] for r in counts):8d}" for c in columns)])]


def percent(share: float, digits: int = 1) -> str:
    return f"{100 * share:.{digits}f}%"


def markdown_lines(title: str, table: DataFrame, shares: Sequence[str] = (), order: str | None = None) -> list[str]:
    """A small table as a section of a Markdown report, by the values of `order` (its first column). `shares` are shown as percentages, other numbers with four digits after the point."""
    def shown(name: str, value) -> str:
        if value is None:
            return ""
        if name in shares:
            return percent(value)
        return f"{value:.4f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")

    names = table.columns
    rows = table.orderBy(order or names[0]).collect()
    head = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "|".join("---" for _ in names) + "|"]
    return [*head, *("| " + " | ".join(shown(c, r[c]) for c in names) + " |" for r in rows)]


def write_report(spark: SparkSession, sections: list[list[str]], path: str) -> None:
    """Sections of a report as one text file at a new path."""
    text = "\n\n".join("\n".join(s) for s in sections)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
