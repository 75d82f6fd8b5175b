"""JSON corpora: manifests, annotations, personal-data manifests, recognised lines; report sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, name string, classes array<string>, pages array<struct<id:string,name:string,description:string,liveUrl:string,snapshot:string,annotations:string,classes:array<string>>>"
ANNOTATIONS = "pageId string, title string, classes array<string>, annotations array<struct<id:string,type:string,selector:string,description:string>>, negativeSelectors array<string>"
BOX = "struct<x:double,y:double,w:double,h:double>"
OCR = f"text string, bbox {BOX}, confidence double, words array<struct<text:string,bbox:{BOX},confidence:double>>"


def manifest(spark: SparkSession, path: str, page: str | None = None) -> DataFrame:
    """Pages of a manifest, one row each; ``page`` picks an id or a part of a name."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.*")
    return rows if page is None else rows.where((F.col("id") == page) | F.contains(F.lower("name"), F.lit(page.lower())))


def annotations(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """Annotations of the pages; a page without a file has empty lists."""
    found = spark.read.schema(ANNOTATIONS).json(path, multiLine=True).select(F.col("pageId").alias("id"), "annotations", "negativeSelectors")
    empty = F.array()
    return pages.select("id").join(found, "id", "left").select("id", F.coalesce("annotations", empty.cast("array<struct<id:string,type:string,selector:string,description:string>>")).alias("annotations"), F.coalesce("negativeSelectors", empty.cast("array<string>")).alias("negative"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, html) of stored pages, one file each."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html?$", 1).alias("page_id"), F.col("value").alias("html"))


def pii_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and raw tokens of a manifest."""
    raw = spark.read.schema("entities array<struct<category:string,value:string,selector:string>>, rawTokens array<string>").json(path, multiLine=True)
    return raw.select(F.explode("entities").alias("e")).select("e.*"), raw.select(F.explode("rawTokens").alias("token"))


def ocr_lines(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Recognised lines from JSON of four shapes: {data: {lines}}, {lines}, an array, one line."""
    line = f"struct<{OCR.replace(' ', ':', 1).replace(', ', ',').replace('bbox ', 'bbox:').replace('confidence double', 'confidence:double').replace('words array', 'words:array')}>"
    at = lambda path: F.from_json(F.get_json_object(column, path), f"array<{line}>")
    whole = F.when(F.startswith(F.ltrim(F.col(column)), F.lit("[")), F.from_json(column, f"array<{line}>"))
    one = F.array(F.from_json(column, line))
    return rows.withColumn("line", F.explode(F.coalesce(at("$.data.lines"), at("$.lines"), whole, one))).drop(column)


def recognised(images: DataFrame, recogniser: Callable[[bytes], list[dict]], key: str = "page_id", column: str = "image") -> DataFrame:
    """Lines that a caller's recogniser finds in images: one row a line, as ``ocr_lines`` gives them.

    The recogniser takes the bytes of one image and returns dicts with text, bbox (x, y, w, h), confidence and words.
    """
    kind = dict(images.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = batch.column(column)[k]
                lines = recogniser(cell.as_py()) if cell.is_valid else []
                yield pa.record_batch([pa.array([batch.column(key)[k].as_py()] * len(lines), batch.schema.field(key).type), pa.array([json.dumps(line) for line in lines], pa.string())], names=[key, "payload"])

    return ocr_lines(images.select(key, column).mapInArrow(run, f"{key} {kind}, payload string"))


def write_report(report: DataFrame, path: str) -> None:
    """A result as JSON lines."""
    report.write.mode("overwrite").json(path)


def markdown(report: DataFrame) -> str:
    """A small result as a Markdown table, all of its rows, read partition by partition."""
    rows = report.toLocalIterator()
    head = "| " + " | ".join(report.columns) + " |\n|" + "-|" * len(report.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
