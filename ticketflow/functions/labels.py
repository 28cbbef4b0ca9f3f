"""Raw labels to categories, categories to teams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_CATEGORY, DEFAULT_TEAM, LABEL_MAP, TEAM_BY_CATEGORY
from .text import norm_label


def clean_map(mapping: dict[str, str]) -> dict[str, str]:
    return {key.lower().strip(): value for key, value in mapping.items()}


def read_label_map(spark: SparkSession, path: str) -> dict[str, str]:
    """A label dictionary from a JSON object in one file: a configuration file, read whole."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return clean_map(json.loads(text))


def label_map_df(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    pairs = clean_map(mapping or LABEL_MAP)
    return spark.createDataFrame(list(pairs.items()), "label string, category string")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalise_labels(labels: Column, mapping: dict[str, str] | None = None) -> Column:
    """Category of the first label, in list order, that the dictionary knows."""
    lookup = literal_map(clean_map(mapping or LABEL_MAP))
    known = F.filter(F.transform(labels, lambda label: lookup[norm_label(label)]), lambda c: c.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(DEFAULT_CATEGORY))


def route_by_category(category: Column) -> Column:
    return F.coalesce(literal_map(TEAM_BY_CATEGORY)[category], F.lit(DEFAULT_TEAM))
