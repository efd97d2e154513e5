"""Ordered series: delays, smoothing, feedback loops; the same as stateful streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.checkpoints import saved
from quadrille.operators.lattice import in_ranges


def _by(keys: tuple[str, ...], order: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def delayed(x: str, k: int, keys: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """The value k ticks ago; the oldest there is before that."""
    w = _by(keys, order)
    return F.coalesce(F.lag(x, k).over(w), F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def delayed_linear(x: str, lag: float, keys: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """A fractional delay between two ticks."""
    k, f = int(math.floor(lag)), lag - math.floor(lag)
    return delayed(x, k, keys, order) * (1 - f) + delayed(x, k + 1, keys, order) * f


def delayed_cubic(x: str, lag: float, keys: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """A fractional delay by the Catmull-Rom curve through four ticks."""
    k, f = int(math.floor(lag)), lag - math.floor(lag)
    p = [delayed(x, max(0, k + i), keys, order) for i in (-1, 0, 1, 2)]
    return 0.5 * (2 * p[1] + (p[2] - p[0]) * f + (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3]) * (f * f) + (3 * p[1] - p[0] - 3 * p[2] + p[3]) * (f * f * f))


def one_pole(series: DataFrame, tau: float, dt: float = 1.0, keys: tuple[str, ...] = ("key",), order: tuple[str, ...] = ("t",), x: str = "x") -> DataFrame:
    """Adds y: y += (1 - exp(-dt / tau)) (x - y), from the first value on. From a missing value on, y is missing.

    Keys and their rows are dealt to ranges, so a long series is no single task. Each piece of a series is folded as if it
    began there; with c before it, y at its n-th row differs by exp(-n dt / tau) (c - first x). Only series that cross a
    bound of two ranges need c, which gives at most two rows for each range."""
    decay = math.exp(-dt / tau)
    held = in_ranges(series, *keys, *order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        y, out = None, []
        for v in pdf[x].tolist():
            y = v if y is None else y + (1 - decay) * (v - y)
            out.append(y)
        return pdf.assign(y=out, _n=range(1, len(out) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    folded = held.groupBy("_part", *keys).applyInPandas(run, f"{schema}, y double, _n long")
    piece = folded.groupBy("_part", *keys).agg(F.coalesce(F.min_by("y", "_n"), F.lit(math.nan)).alias("first"), F.coalesce(F.max_by("y", "_n"), F.lit(math.nan)).alias("last"), F.max("_n").alias("n"))
    pieces = piece.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "first", "last", "n"))).alias("ps")).where(F.size("ps") > 1)
    begin = F.struct(F.lit(None).cast("double").alias("y"), F.expr("cast(array() as array<struct<part:int,gap:double>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        gap = acc["y"] - p["first"]
        y = F.coalesce(p["last"] + F.pow(F.lit(decay), p["n"]) * gap, p["last"])
        return F.struct(y.alias("y"), F.concat(acc["out"], F.array(F.struct(p["_part"].alias("part"), gap.alias("gap")))).alias("out"))

    gaps = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(F.aggregate("ps", begin, step)["out"]).alias("g"))
    on = F.col("_part") == F.col("g.part")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    shift = F.coalesce(F.pow(F.lit(decay), F.col("_n")) * F.col("g.gap"), F.lit(0.0))
    y = F.col("y") + shift
    return folded.join(F.broadcast(gaps), on, "left").select(*series.columns, F.when(~F.isnan(y), y).alias("y"))


def one_pole_stream(stream: DataFrame, tau: float, dt: float = 1.0, key: str = "key", order: str = "t", x: str = "x") -> DataFrame:
    """The same on a stream: the last y of each key is its state. Rows of a micro-batch are folded in order."""
    gain = 1 - math.exp(-dt / tau)
    kind = stream.schema[key].dataType.simpleString()
    order_kind = stream.schema[order].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for v in pdf[x].tolist():
            y = v if y is None else y + gain * (v - y)
            out.append(y)
        if y is not None:
            state.update((y,))
        yield pd.DataFrame({"key": keys[0], "t": pdf[order].to_numpy(), "y": out})

    slim = stream.select(F.col(key).alias(key), F.col(order).alias(order), F.col(x).alias(x))
    return slim.groupBy(key).applyInPandasWithState(step, f"key {kind}, t {order_kind}, y double", "y double", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, ts: str, by: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rows in tumbling windows by a column, with a watermark for late rows; also on static tables."""
    held = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    held = held.withWatermark("_ts", late) if stream.isStreaming else held
    return held.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def feedback(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], ticks: int, every: int = 8) -> DataFrame:
    """state <- step(state, tick), ``ticks`` times; lineage is cut every few ticks."""
    for tick in range(ticks):
        state = step(state, tick)
        if (tick + 1) % every == 0:
            state = saved(state)
    return state
