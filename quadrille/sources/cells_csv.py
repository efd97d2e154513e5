"""Cells from CSV: scan, profile and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that suggest a role.
NAMES = {"x": r"^(x|cx|pos_?x|x_?(coord|pos|centroid|position).*|centroid_?x|.*[_ ]x)$", "y": r"^(y|cy|pos_?y|y_?(coord|pos|centroid|position).*|centroid_?y|.*[_ ]y)$", "type": r"(cell)?_?(type|class|label|cluster|phenotype|annotation)"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings: quoted fields, doubled quotes, line breaks inside quotes; blank lines are dropped."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)


def profile(rows: DataFrame, numeric_share: float = 0.95) -> DataFrame:
    """Per column: place, name, numeric_fraction of its non-empty values, distinct values, over all rows, in one aggregation."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    given = lambda c: text(c).isNotNull() & (F.trim(text(c)) != "")
    measures = []
    for c in rows.columns:
        n = F.count_if(given(c))
        good = F.count_if(given(c) & F.col(f"`{c}`").cast("string").try_cast("double").isNotNull())
        measures.append(F.struct(F.lit(rows.columns.index(c)).alias("place"), F.lit(c).alias("name"), F.when(n > 0, good / n).otherwise(0.0).alias("numeric_fraction"), F.count_distinct(F.when(given(c), text(c))).alias("distinct")))
    return rows.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def suggested(found: list, numeric_share: float = 0.95) -> dict[str, str | None]:
    """x, y and type columns from the rows of a profile: by name, then numeric, then few distinct values."""
    import re

    named = lambda role: next((r["name"] for r in found if re.search(NAMES[role], r["name"], re.I) and (role == "type" or r["numeric_fraction"] > numeric_share)), None)
    x, y = named("x"), named("y")
    rest = [r["name"] for r in found if r["numeric_fraction"] > numeric_share and r["name"] not in (x, y)]
    x = x or (rest.pop(0) if rest else None)
    y = y or (next((r for r in rest if r != x), None))
    few = sorted((r["distinct"], r["place"], r["name"]) for r in found if 2 <= r["distinct"] <= 200 and r["name"] not in (x, y))
    return {"x": x, "y": y, "type": named("type") or (few[0][2] if few else None)}


def typed_cells(rows: DataFrame, x: str, y: str, kind: str, order: str) -> DataFrame:
    """Rows with finite coordinates and a type: x, y, type, first (least ``order`` of the type)."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    held = rows.select(F.col(order).alias("_o"), number(x).alias("x"), number(y).alias("y"), F.trim(F.col(kind).cast("string")).alias("type"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return held.where(finite("x") & finite("y") & F.col("type").isNotNull() & (F.col("type") != ""))


def grouped(rows: DataFrame, x: str, y: str, kind: str, order: str) -> DataFrame:
    """Per type: n cells, first row, mean coordinates; the rest of the rows are skipped."""
    return typed_cells(rows, x, y, kind, order).groupBy("type").agg(F.count("*").alias("n"), F.min("_o").alias("first_row"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def assigned_keys(names: DataFrame, name: str = "name", order: str = "i") -> DataFrame:
    """Adds key: the name with all but letters, digits, dot, underscore and hyphen as underscores; later repeats get __2, __3, .."""
    from pyspark.sql import Window

    safe = F.regexp_replace(F.col(name), r"[^A-Za-z0-9._-]", "_")
    n = F.row_number().over(Window.partitionBy("_safe").orderBy(order))
    return names.withColumn("_safe", safe).withColumn("_n", n).withColumn("key", F.when(F.col("_n") > 1, F.concat("_safe", F.lit("__"), F.col("_n"))).otherwise(F.col("_safe"))).drop("_safe", "_n")
