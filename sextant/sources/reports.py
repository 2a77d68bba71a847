"""Small result tables as one CSV or JSON file with a header, the rows in the order that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the segmentation report, in their order. Fixed values.
SECTION_COLUMNS = ("nregistro", "oficiales", "detectadas", "aciertos", "faltan", "sobran")


def write_csv(rows: DataFrame, path: str, *order: Column | str) -> None:
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str, *order: Column | str) -> None:
    """Nulls stay in the file."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_section_report(report: DataFrame, path: str) -> None:
    """Rows of ``section_report`` (register, n_official, n_detected, hits, missing, extra), the most faults first."""
    words = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    named = report.withColumn("faults", words("missing") + words("extra")).orderBy(F.desc("faults"), "register").drop("faults")
    write_csv(named.toDF(*SECTION_COLUMNS), path)


def write_summary(metrics: dict[str, DataFrame], path: str) -> None:
    """One JSON object with a list of rows for each of the named tables, all of them aggregates."""
    parts = [t.agg(F.collect_list(F.struct(*t.columns)).alias(name)) for name, t in metrics.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(F.broadcast(part))
    write_json(whole, path)
