"""The batch chain with a gate after each layer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import read_label_map
from ..operators.dedup import latest
from ..operators.quality import bronze_gate, gate, silver_gate
from ..sources.readers import read_bronze, read_layer
from ..sources.sinks import path_exists, write_json, write_layer, write_silver
from .gold import build_gold
from .silver import to_silver


RAW_ID = "__raw_id"


@dataclass
class Config:
    """Folders and parameters of one run. ``ingest`` yields Bronze rows; it runs only where Bronze is absent."""
    root: str
    as_of: str
    ingest: Callable[[SparkSession], DataFrame] | None = None
    skip_ingest: bool = False
    min_rows: int = 50_000
    label_map: str | None = None
    ttl: str = "90 DAYS"
    embedder: Callable | None = None
    vectors: bool = True
    dim: int | None = None

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def with_raw_id(bronze: DataFrame) -> DataFrame:
    """A hash of the whole row: the id that tickets with a blank or null id are numbered by.

    Rows that are equal throughout share it; they are copies of one ticket, of which one stays anyway.
    """
    return bronze.withColumn(RAW_ID, F.sha2(F.to_json(F.struct(*sorted(bronze.columns))), 256))


def ingest(spark: SparkSession, cfg: Config) -> bool:
    if cfg.skip_ingest or path_exists(spark, cfg.at("bronze")) or cfg.ingest is None:
        return False
    write_json(cfg.ingest(spark), cfg.at("bronze"))
    return True


def run_flow(spark: SparkSession, cfg: Config) -> DataFrame:
    """Ingest, gate, Silver, gate, Gold, latest features. Returns the Gold summary."""
    ingest(spark, cfg)
    bronze = read_bronze(spark, cfg.at("bronze"))
    gate(bronze, bronze_gate(cfg.min_rows), "bronze")
    mapping = read_label_map(spark, cfg.label_map) if cfg.label_map else None
    write_silver(to_silver(with_raw_id(bronze), RAW_ID, mapping), cfg.at("silver"))
    silver = read_layer(spark, cfg.at("silver"))
    gate(silver, silver_gate(cfg.min_rows), "silver")
    write_silver(silver, cfg.at("silver_by_source"), by="source")
    summary = build_gold(spark, cfg.at("silver"), cfg.at("gold"), cfg.as_of, cfg.embedder, cfg.vectors, cfg.dim)
    train = read_layer(spark, cfg.at("gold/features")).where(F.col("split") == "train")
    write_layer(latest(train, "ticket_id", "event_timestamp", cfg.as_of, cfg.ttl), cfg.at("online"))
    return summary
