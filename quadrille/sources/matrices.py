"""Sparse matrices as long rows (cell, var, value), dense columns, sinks for embeddings and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.checkpoints import saved
from quadrille.operators.lattice import exclusive_scan


def select_columns(x: DataFrame, n_cells: int, wanted: list[int]) -> DataFrame:
    """Wanted columns densely: cell, place (in ``wanted``), var, value; absent or unknown variables are 0, repeats are copied.

    The filter on var reaches the scan."""
    spark = x.sparkSession
    want = spark.createDataFrame(list(enumerate(wanted)), "place int, var int")
    frame = spark.range(n_cells).select(F.col("id").alias("cell")).crossJoin(F.broadcast(want))
    held = x.where(F.col("var").isin(wanted)).select("cell", "var", "value")
    return frame.join(held, ["cell", "var"], "left").select("cell", "place", "var", F.coalesce("value", F.lit(0.0)).alias("value"))


def column_stats(x: DataFrame) -> DataFrame:
    """Per var: total, most (0 at least), non_zero."""
    return x.groupBy("var").agg(F.sum("value").alias("total"), F.greatest(F.max("value"), F.lit(0.0)).alias("most"), F.count_if(F.col("value") != 0).alias("non_zero"))


def to_csr(edges: DataFrame, row: str, col: str, weight: str) -> DataFrame:
    """Per row: begin (entries of the rows before), columns in order and their weights."""
    lists = edges.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("c"), F.col(weight).alias("w")))).alias("e"))
    sizes = exclusive_scan(saved(lists.withColumn("n", F.size("e"))), row, "n")
    return sizes.select(F.col(row).alias("row"), F.col("scan").alias("begin"), F.col("e.c").alias("columns"), F.col("e.w").alias("weights"))


def read_matrix(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """A stored matrix as long rows cell, var, value: rows of sorted columns and weights (csr), columns of sorted rows and
    weights (csc), or one array for each row (dense). ``wanted``: variables; of a csc or long matrix only their rows are read."""
    held = spark.read.parquet(path)
    names = set(held.columns)
    if {"row", "columns", "weights"} <= names:
        long = held.select(F.col("row").alias("cell"), F.explode(F.arrays_zip("columns", "weights")).alias("e")).select("cell", F.col("e.columns").alias("var"), F.col("e.weights").alias("value"))
    elif {"col", "rows", "weights"} <= names:
        held = held.where(F.col("col").isin(wanted)) if wanted is not None else held
        long = held.select(F.col("col").alias("var"), F.explode(F.arrays_zip("rows", "weights")).alias("e")).select(F.col("e.rows").alias("cell"), "var", F.col("e.weights").alias("value"))
    elif {"cell", "values"} <= names:
        long = held.select("cell", F.posexplode("values").alias("var", "value")).where("value <> 0")
    elif {"cell", "var", "value"} <= names:
        long = held.select("cell", "var", "value")
    else:
        raise ValueError(f"no matrix has the columns {sorted(names)}")
    return long.where(F.col("var").isin(wanted)) if wanted is not None else long


def column_cost(encoding: str, wanted: int, variables: int) -> float:
    """Share of a stored matrix that is read for some of its variables: all of it by rows, their own columns otherwise."""
    return 1.0 if encoding in ("csr", "dense") else min(1.0, wanted / variables) if variables else 0.0


def write_embedding(df: DataFrame, path: str, n_cells: int, force: bool = False) -> None:
    """Writes one row per cell. Raises ValueError if their number differs; an existing target stays unless forced."""
    n = df.count()
    if n != n_cells:
        raise ValueError(f"the embedding has {n} rows, the table {n_cells}")
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_graph(edges: DataFrame, path: str, n_cells: int, force: bool = False, about: dict | None = None) -> None:
    """Writes (row, col, weight) and, as a side table of name and value, what is known of the graph."""
    worst = edges.agg(F.max(F.greatest("row", "col")).alias("m")).first()["m"]
    if worst is not None and worst >= n_cells:
        raise ValueError(f"row {worst} is outside the table of {n_cells}")
    mode = "overwrite" if force else "errorifexists"
    edges.select("row", "col", "weight").write.mode(mode).parquet(path)
    write_about(edges.sparkSession, path, about, force)


def write_about(spark: SparkSession, path: str, about: dict | None, force: bool = False) -> None:
    """Writes the side table of the graph at ``path``: name and value of what is known of it."""
    rows = [(k, str(x)) for k, x in (about or {}).items()]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite" if force else "errorifexists").parquet(f"{path}.about")


def remapped(cells: DataFrame, label: str, axis: list[str], ignore_case: bool = False) -> DataFrame:
    """Adds type_id, the place of the label on the axis; rows of other labels are dropped."""
    spark = cells.sparkSession
    fold = F.lower if ignore_case else (lambda c: c)
    dim = spark.createDataFrame([(i, x) for i, x in enumerate(axis)], "type_id int, _label string").select("type_id", fold(F.col("_label")).alias("_label"))
    return cells.withColumn("_label", fold(F.col(label))).join(F.broadcast(dim), "_label").drop("_label")
