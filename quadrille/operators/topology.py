"""Persistent homology of small distance matrices and rasters. Reductions are sequential: one task for each group."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce_columns(simplices: list[tuple[float, int, tuple[int, ...]]]) -> list[tuple[int, float, float]]:
    """(dim, birth, death) from (value, dim, vertices) by column reduction over Z2; zero lengths are left out."""
    order = sorted(simplices, key=lambda s: (s[0], s[1], s[2]))
    place = {s[2]: i for i, s in enumerate(order)}
    low: dict[int, int] = {}
    columns: dict[int, set[int]] = {}
    paired: set[int] = set()
    out = []
    for j, (value, dim, vertices) in enumerate(order):
        column = {place[f] for f in combinations(vertices, dim)} if dim else set()
        while column and max(column) in low:
            column ^= columns[low[max(column)]]
        if column:
            i = max(column)
            low[i], columns[j] = j, column
            paired |= {i, j}
            if order[i][0] < value:
                out.append((order[i][1], order[i][0], value))
    return sorted(out + [(d, v, np.inf) for j, (v, d, _) in enumerate(order) if j not in paired])


def rips(distances: DataFrame, most: float, dims: int = 2) -> DataFrame:
    """(dim, birth, death) of the Vietoris-Rips complex of (i, j, d) up to a scale; essential classes die at infinity.

    The complex has up to n^3 / 6 triangles, so this is for small n; classes of the highest dimension are artefacts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["i"]) | set(pdf["j"]))
        at = {x: k for k, x in enumerate(ids)}
        d = {(min(at[i], at[j]), max(at[i], at[j])): v for i, j, v in pdf[["i", "j", "d"]].itertuples(index=False) if i != j}
        simplices = [(0.0, 0, (k,)) for k in range(len(ids))] + [(v, 1, e) for e, v in d.items() if v <= most]
        near = {e for e, v in d.items() if v <= most}
        if dims >= 2:
            simplices += [(max(d[e] for e in combinations(t, 2)), 2, t) for t in combinations(range(len(ids)), 3) if all(e in near for e in combinations(t, 2))]
        return pd.DataFrame(reduce_columns(simplices), columns=["dim", "birth", "death"])

    return distances.select(F.lit(0).alias("all"), "i", "j", "d").groupBy("all").applyInPandas(run, "dim int, birth double, death double")


def betti(diagram: DataFrame, scale: float) -> DataFrame:
    """Classes alive at a scale: dim, n."""
    return diagram.where((F.col("birth") <= scale) & (F.col("death") > scale)).groupBy("dim").agg(F.count("*").alias("n"))


def sublevel(grid: DataFrame, keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """(dim, birth, death) of the sublevel sets of every raster, pixels as vertices of a cubical complex."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        w, h = int(pdf["col"].max()) + 1, int(pdf["row"].max()) + 1
        v = pdf["v"].to_numpy().reshape(h, w)
        cells = [(v[r, c], 0, ((r, c), (r, c))) for r in range(h) for c in range(w)]
        cells += [(max(v[r, c], v[r, c + 1]), 1, ((r, c), (r, c + 1))) for r in range(h) for c in range(w - 1)]
        cells += [(max(v[r, c], v[r + 1, c]), 1, ((r, c), (r + 1, c))) for r in range(h - 1) for c in range(w)]
        cells += [(v[r : r + 2, c : c + 2].max(), 2, ((r, c), (r + 1, c + 1))) for r in range(h - 1) for c in range(w - 1)]
        order = sorted(cells, key=lambda s: (s[0], s[1], s[2]))
        place = {s[2]: i for i, s in enumerate(order)}

        def faces(dim: int, span) -> list:
            (a, b), (c, d) = span
            if dim == 1:
                return [((a, b), (a, b)), ((c, d), (c, d))]
            return [((a, b), (a, d)), ((c, b), (c, d)), ((a, b), (c, b)), ((a, d), (c, d))] if dim else []

        low: dict[int, int] = {}
        columns: dict[int, set[int]] = {}
        paired: set[int] = set()
        out = []
        for j, (value, dim, span) in enumerate(order):
            column = {place[f] for f in faces(dim, span)}
            while column and max(column) in low:
                column ^= columns[low[max(column)]]
            if column:
                i = max(column)
                low[i], columns[j] = j, column
                paired |= {i, j}
                if order[i][0] < value:
                    out.append((order[i][1], order[i][0], value))
        out += [(d, x, np.inf) for j, (x, d, _) in enumerate(order) if j not in paired]
        first = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([(*first, *o) for o in sorted(out)], columns=[*keys, "dim", "birth", "death"])

    kinds = {f.name: f.dataType.simpleString() for f in grid.schema.fields}
    return grid.select(*keys, "row", "col", "v").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", dim int, birth double, death double")
