"""Station CSVs, text documents and JSON artefacts."""
from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..operators import timeseries as TS
from ..operators.bounds import broadcast_if_small
from ..session import cut_lineage


def _file_name() -> Column:
    """The file's name as it is on disk; the metadata column holds it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def station_history(spark: SparkSession, path: str, station: Column | None = None) -> DataFrame:
    """Hourly series of station CSVs: known columns only, last row of a repeated stamp, hourly median, no missing hour.

    Columns are bound by the header of their own file, in whatever order it has them. Rows are read in file order for
    "last"; ``station`` derives the series key (default: the file's name without its ending).
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), _file_name().alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("first"))
    heads = cut_lineage(heads)
    rows = lines.join(broadcast_if_small(heads), "file").where(F.col("at") != F.col("first"))
    parts = [_station_rows(rows, r.header, station) for r in heads.select("header").distinct().orderBy("header").collect()]  # a row per layout
    if not parts:
        raise ValueError(f"no station file in {path}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    values = [c for c in dict.fromkeys(K.STATION_CSV_COLUMNS.values()) if c in rows.columns]
    rows = TS.keep_last(rows.where(F.col("ts").isNotNull()), ["station", "ts"], "_order").drop("_order")
    return TS.densify(TS.hourly_median(rows, ["station"], "ts", values), ["station"])


def _station_rows(lines: DataFrame, header: str, station: Column | None) -> DataFrame:
    """The lines of all files with one header, parsed by it. A field that holds a line break is not supported."""
    names = [c.strip() for c in next(csv.reader([header.lstrip("\ufeff")]))]
    stamp = "Timestamp" if "Timestamp" in names else "timestamp"
    field = lambda c: F.col(f"_c.c{names.index(c)}")
    parsed = lines.where(F.col("header") == header).withColumn(
        "_c", F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(len(names)))))
    have = [c for c in K.STATION_CSV_COLUMNS if c in names]
    name = F.regexp_replace("file_name", r"\.[^.]*$", "")
    number = lambda c, kind: field(c).try_cast(kind)
    return parsed.select(
        (station if station is not None else name).alias("station"), number(stamp, "timestamp").alias("ts"),
        F.struct("file", "block", "at").alias("_order"), *[number(c, "double").alias(K.STATION_CSV_COLUMNS[c]) for c in have])


def text_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Text files as one page each: (doc_name, page, text, source_type, error)."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return raw.select(_file_name().alias("doc_name"), F.lit(1).alias("page"),
                      F.col("value").alias("text"), F.lit("text").alias("source_type"), F.lit(None).cast("string").alias("error"))


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files, one row per page from 1. A file that is no PDF is its UTF-8 text, page 1.

    A file that is neither, or a damaged PDF, is a row without page and text that holds the error, so that no file
    vanishes. PDFs need a library on the executors (pypdf); without it reading one fails.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(
        _file_name().alias("doc_name"), "content")

    def pages(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["doc_name"], batch["content"]):
                rows += [(name, *p) for p in _pages_of(content)]
            yield pd.DataFrame(rows, columns=["doc_name", "page", "text", "source_type", "error"]).astype({"page": "Int32"})

    return raw.mapInPandas(pages, "doc_name string, page int, text string, source_type string, error string")


def _pages_of(content: bytes) -> list[tuple]:
    if b"%PDF-" not in content[:1024]:
        try:
            return [(1, content.decode("utf-8"), "text", None)]
        except UnicodeDecodeError as e:
            return [(None, None, "pdf", f"{type(e).__name__}: {e.reason}")]
    import pypdf  # its absence is a fault of the cluster, not of the file

    try:
        return [(i, p.extract_text() or "", "pdf", None) for i, p in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, start=1)]
    except Exception as e:  # whatever the library raises on a damaged file
        return [(None, None, "pdf", f"{type(e).__name__}: {e}")]


def all_pages(spark: SparkSession, folder: str) -> DataFrame:
    """PDF pages, then text files. Order by (source_type, doc_name, page) where a list order is wanted."""
    return pdf_pages(spark, folder).unionByName(text_pages(spark, folder))


def json_artifact(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def importance_rows(artifact: DataFrame) -> DataFrame:
    """{feature: value, ...} object to (feature, importance)."""
    names = artifact.columns
    return artifact.unpivot([], [F.col(f"`{n}`").cast("double").alias(n) for n in names], "feature", "importance")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file."""
    return json_artifact(spark, path, "question STRING, reference_answer STRING, expected_topics ARRAY<STRING>")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
