"""Scans of text files: CSV where every value is a string, and JSON in five shapes.

Schemas are declared or all strings, never inferred from data; casts are the caller's, column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

ID_COLUMNS = ("text_asset_id", "sample_id", "id")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, quote='"', escape='"').columns


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, blanks "" and not null, quoted line breaks allowed; columns in the header's order."""
    schema = StructType()
    for name in csv_header(spark, path):
        schema = schema.add(name, StringType())
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"').na.fill("")


def csv_split(spark: SparkSession, path: str, split: str | None = None, column: str = "split", required: bool = False) -> DataFrame:
    """Rows of one split, or all. `required`: no row is an error."""
    rows = csv_rows(spark, path)
    rows = rows if split is None else rows.where(F.col(column) == split)
    if required and rows.isEmpty():
        raise ValueError(f"no rows of split {split!r} in {path}")
    return rows


def id_column(df: DataFrame) -> str:
    """The id column, by precedence."""
    for name in ID_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {ID_COLUMNS} is a column")


def caption_rows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Rows for feature extraction: an id column, a text column, no id twice."""
    rows = csv_split(spark, path, split)
    if "text" not in rows.columns:
        raise ValueError("a text column is needed")
    key = id_column(rows)
    twice = [r[0] for r in rows.groupBy(key).count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"ids more than once: {twice}")
    return rows


def json_array(spark: SparkSession, path: str, record: str, prefix: str = "row") -> DataFrame:
    """A file that is one array of records: the record's columns, `ordinal`, and an id of prefix, file stem and ordinal.

    The array is parsed as one value, so that its order survives; a root of another kind is an error.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("_stem", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.json)?(?:\.gz)?$", 1))
    parsed = F.from_json("value", f"array<{record}>")
    checked = F.when(~F.ltrim("value").startswith("[") | parsed.isNull(), F.raise_error(F.lit(f"{path} holds no array")).cast(f"array<{record}>")).otherwise(parsed)
    rows = whole.select("_stem", F.posexplode(checked).alias("ordinal", "r"))
    return rows.select(F.concat_ws("_", F.lit(prefix), "_stem", F.col("ordinal").cast("string")).alias("row_id"), "ordinal", "r.*")


def annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, image_id, files) of the annotations that are not falsified, with the files that hold them. `falsified` must be a boolean."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "annotations array<struct<id: string, image_id: string, falsified: string>>").alias("j"))
    rows = raw.select("file", F.explode("j.annotations").alias("a")).select("file", "a.*")
    flag = F.when(F.col("falsified").isin("true", "false"), F.col("falsified") == "true").otherwise(F.raise_error(F.lit("falsified is no boolean")).cast("boolean"))
    kept = rows.withColumn("falsified", flag).where("NOT falsified")
    same = F.when(F.col("id") != F.col("image_id"), F.raise_error(F.concat(F.lit("ids differ at "), F.col("id"))).cast("string")).otherwise(F.col("image_id"))
    return kept.groupBy("id").agg(F.max(same).alias("image_id"), F.array_sort(F.collect_set("file")).alias("files"))


def json_map(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A file that is one object of records by id: (id, the record's columns)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {record}>").alias("m"))
    return whole.select(F.explode("m").alias("id", "r")).select("id", "r.*")


def matched_candidates(bank: DataFrame, pristine: DataFrame) -> DataFrame:
    """Bank records with a pristine annotation, as candidate rows of the genuine group."""
    rows = bank.join(pristine.select("id", "files"), "id")
    constant = {"source": "newsclippings", "group": "genuine", "raw_label": "falsified=false", "split": "train"}
    return rows.select(F.concat(F.lit("nc_genuine_"), "id").alias("sample_id"), F.col("id").alias("caption_id"), F.col("id").alias("image_id"), F.col("caption").alias("text"), "image_path", *(F.lit(v).alias(k) for k, v in constant.items()), "files")


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record a line; .gz is read as such. Without a schema one pass over the data infers it."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


#: Classes of the face-manipulation source that are used.
ANNOTATED_CLASSES = ("orig", "face_swap", "face_attribute")


def class_annotations(spark: SparkSession, path: str | list[str], schema: str, classes: tuple[str, ...] = ANNOTATED_CLASSES) -> DataFrame:
    """Annotations (JSON lines, or one array in a file, which one task then reads) of the wanted classes; an image twice is an error."""
    rows = spark.read.schema(schema).json(path).where(F.col("fake_cls").isin(*classes))
    if not rows.groupBy("image").count().where("count > 1").isEmpty():
        raise ValueError("an image is annotated more than once")
    return rows


def named_files(spark: SparkSession, glob: str, pattern: str, name: str, reader: str = "csv") -> DataFrame:
    """Files (or their folders) whose names carry a number: CSV (or JSON) rows with the number that `pattern` finds as column `name`."""
    rows = spark.read.csv(glob, header=True) if reader == "csv" else spark.read.json(glob)
    return rows.withColumn(name, F.regexp_extract(F.substring_index("_metadata.file_path", "/", -2), pattern, 1).cast("int"))


def feature_rows(spark: SparkSession, store: str, encoder: str, dataset: str, condition: str | None = None) -> DataFrame:
    """Rows of the feature store, a table partitioned by encoder, dataset and condition: other partitions aren't opened."""
    rows = spark.read.parquet(store).where((F.col("encoder") == encoder) & (F.col("dataset") == dataset))
    return rows if condition is None else rows.where(F.col("condition") == condition)


def development_rows(df: DataFrame, key: str = "sample_id", split: str = "split") -> DataFrame:
    """A development cache: no test row, no id twice."""
    if not df.where(F.col(split) == "test").isEmpty():
        raise ValueError("test rows in a development cache")
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("ids more than once")
    return df


def fusion_bundle(df: DataFrame, sizes: dict[str, int], splits: tuple[str, ...], key: str = "sample_id") -> DataFrame:
    """Rows of `splits` of a bundle of vectors, with sizes, finite values, scenarios 1 to 5 and unique ids checked."""
    from quillmark.functions.arrays import all_finite

    rows = df.where(F.col("split").isin(*splits))
    good: Column = F.col("scenario").between(1, 5)
    for name, n in sizes.items():
        good = good & (F.size(name) == n) & all_finite(F.col(name))
    if not rows.where(~F.coalesce(good, F.lit(False))).isEmpty():
        raise ValueError("vectors or scenarios of the wrong form")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("ids more than once")
    return rows
