"""Scored rows derived from `documents`: a stand-in for model outputs, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.labels import binary_label
from quillmark.sources.tables import table


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang, source, n_chars, scenario, label, prob (rounded to thousandths, so scores tie), rough (wider scores)."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    u = F.pmod(F.col("doc_id") * 7919 + 104729, F.lit(10007)).cast("double") / F.lit(10007.0)
    d = d.withColumn("scenario", (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).withColumn("label", binary_label(F.col("scenario")))
    d = d.withColumn("rough", F.lit(0.35) * F.col("label").cast("double") + F.lit(0.65) * u)
    d = d.withColumn("prob", F.floor(F.col("rough") * 1000.0).cast("double") / 1000.0)
    return d.withColumns({"caption_id": F.col("doc_id") - F.pmod("doc_id", F.lit(2)), "pair_scenario": F.when(F.pmod("doc_id", F.lit(2)) == 0, 4).otherwise(1), "evaluation_group": F.when(F.pmod(F.floor(F.col("doc_id") / 5), F.lit(2)) == 0, "v1_five_scenarios").otherwise("paired_news")})


SCORED_SQL = """
scored AS (
  SELECT *, doc_id - doc_id % 2 AS caption_id, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 1 END AS pair_scenario,
         CASE WHEN (doc_id // 5) % 2 = 0 THEN 'v1_five_scenarios' ELSE 'paired_news' END AS evaluation_group,
         floor(rough * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS prob
  FROM (SELECT *, CASE WHEN scenario = 4 THEN 0 ELSE 1 END AS label,
               CAST(0.35 AS DOUBLE) * CAST(CASE WHEN scenario = 4 THEN 0 ELSE 1 END AS DOUBLE)
               + CAST(0.65 AS DOUBLE) * (CAST((doc_id * 7919 + 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)) AS rough
        FROM (SELECT doc_id, lang, source, n_chars, CAST(doc_id % 5 + 1 AS INTEGER) AS scenario FROM documents))
)"""
