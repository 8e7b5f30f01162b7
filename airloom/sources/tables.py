"""The Parquet tables and their reading-shaped view."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..operators.bounds import spread_if_few
from ..session import configure

# Event types stand in for pollutants, users for stations.
EVENT_PARAMETERS = {"view": "pm25", "click": "pm10", "purchase": "no2", "error": "so2", "signup": "co"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its timestamps as instants (UTC session)."""
    df = configure(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores when it comes in few splits."""
    return spread_if_few(table(spark, folder, name))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as long readings (parameter, value, unit, date_utc, location, seq)."""
    e = table(spark, folder, "events")
    pairs = [F.lit(x) for kv in EVENT_PARAMETERS.items() for x in kv]
    k = F.get_json_object("props", "$.k").cast("int")
    unit = (
        F.when(k < 40, "µg/m³").when(k < 55, "μg/m³").when(k < 70, "ppb").when(k < 80, "ppm")
        .when(k < 90, "mg/m³").when(k < 95, " UG/M3 ")
    )
    return e.select(
        F.create_map(*pairs)[F.col("event_type")].alias("parameter"), "value", unit.alias("unit"),
        F.col("ts").alias("date_utc"), F.concat(F.lit("station-"), F.col("user_id").cast("string")).alias("location"),
        F.col("event_id").alias("seq"))


def documents_as_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = texts(spark, folder, "documents")
    kind = F.when(F.col("lang") == "en", "pdf").otherwise("text")
    name = F.concat("source", F.lit("-"), F.when(F.col("lang") == "fr", "research").when(
        F.col("lang") == "de", "official").when(F.col("lang") == "es", "historical").otherwise("notes"), F.lit("-"),
        F.col("doc_id").cast("string"))
    return d.select("doc_id", name.alias("doc_name"), F.lit(1).alias("page"), "text", kind.alias("source_type"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


__all__ = ["table", "readings", "documents_as_pages", "questions", "EVENT_PARAMETERS", "K"]
