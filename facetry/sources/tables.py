"""Reading tables, and writing reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types are inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write(report: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """A report as files of a kind that Spark writes; CSV gets a header."""
    report.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def as_html(report: DataFrame, most: int = 10_000) -> str:
    """A report for reading as an HTML table, null as an empty cell. More than ``most`` rows raise: they are no report."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    return "\n".join(["<table>", line("th", report.columns), *[line("td", r) for r in rows], "</table>"])
