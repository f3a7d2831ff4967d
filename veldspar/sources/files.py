"""File sources and sinks of records, pages and reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A catalog with a header; empty texts are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str, absent_ok: bool = False) -> DataFrame:
    """Files that are one JSON array each; with ``absent_ok`` no rows where there is no file."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if absent_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def json_by_folder(spark: SparkSession, pattern: str, schema: StructType | str, column: str = "model_slug") -> DataFrame:
    """JSON arrays of all files of a pattern, with the name of each file's folder."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return rows.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def whole_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, html): whole files; invalid bytes are replaced."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def unwrapped(rows: DataFrame, record: str = "canonical_record") -> DataFrame:
    """Wrapped records as plain rows: the record's fields beside the wrapper's own columns; bare rows stay."""
    if record not in rows.columns:
        return rows
    inner = [f.name for f in rows.schema[record].dataType.fields]
    return rows.select(*(c for c in rows.columns if c != record and c not in inner), f"{record}.*")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """These columns in this order, with a header; other columns are left out, missing ones are empty."""
    rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """More JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def _whole(rows: DataFrame, order: list[Column], most: int) -> list:
    """All rows of a report, which is small; more than ``most`` are an error, never cut."""
    held = rows.orderBy(*order).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a report of more than {most} rows (the table has {rows.count()}): write it as a table")
    return held


def write_json_array(rows: DataFrame, order: list[Column], path: str, most: int = 100_000) -> None:
    """A small report as one indented JSON array, nulls kept, in a folder of one part."""
    told = rows.withColumn("__json", F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}))
    text = json.dumps([json.loads(r["__json"]) for r in _whole(told, order, most)], indent=2, ensure_ascii=False)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, order: list[Column], most: int = 100_000) -> str:
    """A report table of all rows of a small aggregate."""
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(rows.columns), "|" + "---|" * len(rows.columns), *map(line, _whole(rows, order, most))]) + "\n"


def write_markdown(sections: dict[str, tuple[DataFrame, list[Column]]], title: str, path: str) -> None:
    """A report of headed tables, each with its order, in a folder of one part."""
    parts = [f"# {title}\n", *(f"## {name}\n\n{markdown(rows, order)}" for name, (rows, order) in sections.items())]
    spark = next(iter(sections.values()))[0].sparkSession
    spark.createDataFrame([("\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_batch(folder: str, title: str, tables: dict[str, tuple[DataFrame, list[str]]], lines: dict[str, DataFrame], sections: dict[str, tuple[DataFrame, list[Column]]]) -> None:
    """All outputs of an enrichment batch under one folder: CSV tables of fixed columns
    (enriched records, dispositions, overlaps), JSON lines (candidates, manifests, reviews) and
    the report, as a page and as JSON arrays of its sections."""
    for name, (rows, columns) in tables.items():
        write_csv(rows, f"{folder}/{name}.csv", columns)
    for name, rows in lines.items():
        write_json(rows, f"{folder}/{name}.json")
    for name, (rows, order) in sections.items():
        write_json_array(rows, order, f"{folder}/report/{name.replace(' ', '_')}.json")
    write_markdown(sections, title, f"{folder}/report.md")
