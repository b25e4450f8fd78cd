"""Groups, flags, scenarios and folders: fixed vocabularies as small tables and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The five groups in the order of their scenario numbers 1 to 5, with
# (text is fake, image is fake, out of context).
GROUPS = {
    "ooc": (0, 0, 1),
    "fake_text_real_image": (1, 0, 0),
    "real_text_fake_image": (0, 1, 0),
    "genuine": (0, 0, 0),
    "fake_text_fake_image": (1, 1, 0),
}

# Folders of the benchmark source by group.
FOLDERS = {
    "genuine": ("bbc", "guardian", "usa_today", "wash", "coco", "fakeddit"),
    "ooc": ("Newsclipings_person", "Newsclipings_scene", "Newsclipings_semantic"),
    "fake_text_real_image": ("rumor_match", "politicat_match", "gossipcop_match", "chatgpt_match", "DGM4_text_edit_senti"),
    "real_text_fake_image": ("Fakeddit_photo_edit", "antifact_image_generation", "coco_image_edit"),
    "fake_text_fake_image": ("fever_AI", "llm_rewrite", "llm_gossip_md_generation", "llm_science_md_generation", "gossipcop_midjourney", "coco_text_edit"),
}

# Published totals of the benchmark source by fake_cls.
CONTROL_TOTALS = {"original": 3300, "textual_veracity_distortion": 3300, "visual_veracity_distortion": 1100, "mismatch": 3300}

# Class ids by scenario. The two five-class codings differ on scenarios 2 and 3.
RECODINGS = {
    "three_class": {1: 1, 2: 2, 3: 2, 4: 0, 5: 2},
    "five_class_fit": {1: 1, 2: 2, 3: 3, 4: 0, 5: 4},
    "five_class_fusion": {1: 1, 2: 3, 3: 2, 4: 0, 5: 4},
}

GENUINE = 4


def group_table(spark: SparkSession) -> DataFrame:
    rows = [(g, k + 1, k, 0 if g == "genuine" else 1, *flags) for k, (g, flags) in enumerate(GROUPS.items())]
    return spark.createDataFrame(rows, "`group` string, scenario int, label_index int, label_binary int, text_fake int, image_fake int, ooc int")


def folder_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, g) for g, folders in FOLDERS.items() for f in folders], "folder string, `group` string")


def classify_folders(records: DataFrame, folder: str) -> DataFrame:
    """Adds `group` by the folder's name; an unknown folder is an error."""
    known = F.broadcast(folder_table(records.sparkSession).withColumnRenamed("folder", folder))
    group = F.when(F.col("group").isNull(), F.raise_error(F.concat(F.lit("unknown folder "), F.coalesce(F.col(folder), F.lit("null"))))).otherwise(F.col("group"))
    return records.join(known, folder, "left").withColumn("group", group)


def scenario_group(scenario: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GROUPS)), scenario)


def group_of_flags(text_fake: Column, image_fake: Column, ooc: Column) -> Column:
    """The group of three flags, null where the triple has none."""
    out = F.lit(None).cast("string")
    for group, flags in GROUPS.items():
        out = F.when((text_fake == flags[0]) & (image_fake == flags[1]) & (ooc == flags[2]), F.lit(group)).otherwise(out)
    return out


def recode(scenario: Column, coding: str) -> Column:
    pairs = [F.lit(x) for pair in RECODINGS[coding].items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), scenario)


def binary_label(scenario: Column) -> Column:
    return F.when(scenario == GENUINE, F.lit(0)).otherwise(F.lit(1))

# Who wrote the text of a folder; folders in neither set are edited by rule and have no label.
AI_WRITTEN = ("chatgpt_match", "fever_AI", "llm_rewrite", "llm_gossip_md_generation", "llm_science_md_generation")
HUMAN_WRITTEN = ("bbc", "guardian", "usa_today", "wash", "coco", "fakeddit", "Newsclipings_person", "Newsclipings_scene", "Newsclipings_semantic", "rumor_match", "politicat_match", "gossipcop_match", "gossipcop_midjourney", "Fakeddit_photo_edit", "antifact_image_generation", "coco_image_edit")

# Topic domains; any other folder is `other`.
DOMAINS = {
    "gossip": ("gossipcop_match", "gossipcop_midjourney", "llm_gossip_md_generation"),
    "science": ("llm_science_md_generation",),
    "fact": ("fever_AI",),
    "politics": ("politicat_match",),
    "rumour": ("rumor_match",),
    "news": ("bbc", "guardian", "usa_today", "wash", "Newsclipings_person", "Newsclipings_scene", "Newsclipings_semantic", "DGM4_text_edit_senti"),
    "captions": ("coco", "coco_image_edit", "coco_text_edit"),
    "social": ("fakeddit", "Fakeddit_photo_edit"),
    "mixed": ("chatgpt_match", "llm_rewrite", "antifact_image_generation"),
}


def authorship(folder: Column) -> Column:
    """1 written by a model, 0 by people, null unknown."""
    return F.when(folder.isin(*AI_WRITTEN), F.lit(1)).when(folder.isin(*HUMAN_WRITTEN), F.lit(0))


def domain(folder: Column) -> Column:
    out = F.lit("other")
    for name, folders in DOMAINS.items():
        out = F.when(folder.isin(*folders), F.lit(name)).otherwise(out)
    return F.when(folder.isNotNull(), out)
