"""Choices made on the driver before a scan: windows, levels, grids, transforms, strategies; results that are kept.

These are small computations on metadata. What they choose goes into the filters of a plan.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import compose
from quadrille.functions.scales import UNITS

Box = tuple[float, float, float, float]
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def clamped_window(want: Box, extent: Box, most_area: float, most_side: float = math.inf) -> Box | None:
    """The wanted window within the extent, shrunk about its middle to the area and side allowed; None if they don't meet."""
    x0, y0, x1, y1 = max(want[0], extent[0]), max(want[1], extent[1]), min(want[2], extent[2]), min(want[3], extent[3])
    if not (x0 < x1 and y0 < y1):
        return None
    w, h = x1 - x0, y1 - y0
    shrink = min(1.0, math.sqrt(most_area / (w * h)), most_side / max(w, h))
    if shrink == 1.0:
        return x0, y0, x1, y1
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return cx - w * shrink / 2, cy - h * shrink / 2, cx + w * shrink / 2, cy + h * shrink / 2


def density_grid(visible: Box, pixels: tuple[int, int], data: Box, sigma: float, radius_sigma: float = 3.0, cells_per_sigma: float = 2.0, pixels_per_cell: float = 4.0, margin: float = 0.25, most_cells: int = 1 << 20) -> tuple[Box, int, int, float] | None:
    """(box, width, height, cell) of the grid that a view needs, snapped to whole cells; None if nothing of the field is seen.

    A cell is as wide as the view's pixels or the kernel ask for, and grows until there are at most ``most_cells``."""
    reach = sigma * radius_sigma
    wide, high = (visible[2] - visible[0]) * margin, (visible[3] - visible[1]) * margin
    region = (max(visible[0] - wide, data[0] - reach), max(visible[1] - high, data[1] - reach), min(visible[2] + wide, data[2] + reach), min(visible[3] + high, data[3] + reach))
    if region[0] >= region[2] or region[1] >= region[3]:
        return None
    per_pixel = max((visible[2] - visible[0]) / max(1, pixels[0]), (visible[3] - visible[1]) / max(1, pixels[1]))
    cell = max(per_pixel * pixels_per_cell, sigma / cells_per_sigma)
    while True:
        box = (math.floor(region[0] / cell) * cell, math.floor(region[1] / cell) * cell, math.ceil(region[2] / cell) * cell, math.ceil(region[3] / cell) * cell)
        w, h = max(1, round((box[2] - box[0]) / cell)), max(1, round((box[3] - box[1]) / cell))
        if w * h <= most_cells:
            return box, w, h, cell
        cell *= 1.01 * math.sqrt(w * h / most_cells)


def chosen_tiles(tiles: DataFrame, window: Box, eye: tuple[float, float, float], detail: float = 1.0, least_level: int = 0) -> DataFrame:
    """Tiles of a pyramid (level, tx, ty, x0, y0, x1, y1, bytes; level 0 the finest, each tile four of the finer level) that a
    view needs: those that meet the window, at the coarsest level that is fine enough for their distance from the eye.

    Level wanted: floor(log2(depth * detail)), so every part of the window is covered by one tile. One filter: no descent,
    as a tile stands exactly if it is coarse enough itself and its parent is not."""
    top = tiles.agg(F.max("level")).first()[0] or 0
    side = lambda c, lo, hi: F.greatest(F.col(lo) - c, F.lit(0.0), c - F.col(hi))
    depth = lambda t: F.sqrt(t[0] * t[0] + t[1] * t[1] + eye[2] * eye[2])
    wanted = lambda d: F.greatest(F.lit(least_level), F.least(F.lit(top), F.floor(F.log2(F.greatest(d * detail, F.lit(1e-9)))))).cast("int")
    own = depth((side(F.lit(eye[0]), "x0", "x1"), side(F.lit(eye[1]), "y0", "y1")))
    held = tiles.withColumn("depth", own).withColumn("wanted", wanted(F.col("depth")))
    parent = held.select((F.col("level") - 1).alias("level"), F.col("tx").alias("px"), F.col("ty").alias("py"), (F.col("wanted") < F.col("level")).alias("split"))
    held = held.withColumns({"px": F.floor(F.col("tx") / 2).cast("int"), "py": F.floor(F.col("ty") / 2).cast("int")}).join(F.broadcast(parent), ["level", "px", "py"], "left")
    stands = (F.col("wanted") >= F.col("level")) | (F.col("level") == least_level)
    meets = (F.col("x0") <= window[2]) & (F.col("x1") >= window[0]) & (F.col("y0") <= window[3]) & (F.col("y1") >= window[1])
    return held.where(meets & stands & F.coalesce("split", F.lit(True))).select("level", "tx", "ty", "depth", "bytes")


def tiles_within(tiles: DataFrame, window: Box, eye: tuple[float, float, float], most_bytes: int, detail: float = 1.0) -> DataFrame:
    """``chosen_tiles`` at the finest level floor whose bytes fit. Raises MemoryError if even the coarsest doesn't."""
    for floor in range((tiles.agg(F.max("level")).first()[0] or 0) + 1):
        found = chosen_tiles(tiles, window, eye, detail, floor)
        if (found.agg(F.sum("bytes")).first()[0] or 0) <= most_bytes:
            return found
    raise MemoryError("out of memory")


def neighbour_strategy(n: int, crossover: int = 5000) -> str:
    """"exact" for few rows, else "descent"."""
    return "exact" if n < crossover else "descent"


def neighbours_of(vectors: DataFrame, k: int, crossover: int = 5000) -> DataFrame:
    """The k nearest vectors by the strategy for their number."""
    from quadrille.operators.vectors import knn, knn_approx

    return (knn if neighbour_strategy(vectors.count(), crossover) == "exact" else knn_approx)(vectors, k)


def warp_valid(low: Column, high: Column, kind: str | float | None) -> Column:
    """Whether a control's scale can run from low to high: exp needs bounds of one sign, a curve a finite exp."""
    if isinstance(kind, (int, float)):
        return F.lit(math.isfinite(kind) and kind < 709.78)
    if kind == "exp":
        return (low != 0) & (high != 0) & (F.signum(low) == F.signum(high))
    return F.lit(kind in (None, "lin", "amp", "db"))


def resolved_unit(unit: str | None, context: dict, resolvers: list[tuple[set[str], Callable[[str, dict], float | None]]] = ()) -> tuple[str, float] | None:
    """(label, factor to its base) of a unit, by the first resolver that claims it; other names are units of their own.
    None if there is no unit or its resolver can't tell in this context."""
    if unit is None:
        return None
    for names, factor in resolvers:
        if unit in names:
            found = factor(unit, context)
            return None if found is None else (unit, found)
    return unit, 1.0


def resolve_space(transformations: list[dict] | None, target: str | None = None, axes: list[dict] = ()) -> dict | None:
    """A list of coordinate transformations as one map of the plane: affine (x' = a x + b y + c, y' = d x + e y + f), system,
    unit, micrometres, unsupported (types that were passed over).

    Transformations with outputs are alternatives: the one to ``target``, else the first. Others follow one another. Axes
    are found by name, or are the last two, y before x."""
    if not transformations:
        return None
    chosen = next((t for t in transformations if target and (t.get("output") or {}).get("name") == target), transformations[0])
    unsupported: list[str] = []

    def spots(own: list[dict], n: int) -> tuple[int, int]:
        names = [str(a.get("name", "")).lower() for a in own]
        return (names.index("x") if "x" in names else n - 1), (names.index("y") if "y" in names else n - 2)

    def plane(t: dict, around: list[dict]) -> tuple[float, ...]:
        own, kind = (t.get("input") or {}).get("axes") or around, t.get("type", "")
        if kind in ("scale", "translation"):
            values = t.get(kind)
            rest = 1.0 if kind == "scale" else 0.0
            pick = lambda i: float(values[i]) if values and 0 <= i < len(values) and isinstance(values[i], (int, float)) else rest
            x, y = (pick(i) for i in spots(own, len(values or ())))
            return (x, 0.0, 0.0, 0.0, y, 0.0) if kind == "scale" else (1.0, 0.0, x, 0.0, 1.0, y)
        if kind == "sequence":
            out = IDENTITY
            for step in t.get("transformations") or []:
                out = compose(out, plane(step, own))
            return out
        if kind == "affine":
            names = {str(a.get("name", "")).lower() for a in own}
            if t.get("affine") and {"x", "y"} <= names:
                i, j = spots(own, len(own))
                m = t["affine"]
                return tuple(float(m[r][c]) for r in (i, j) for c in (i, j, len(m[r]) - 1))
            unsupported.append("affine (unnamed axes)")
        elif kind and kind != "identity":
            unsupported.append(kind)
        return IDENTITY

    affine = IDENTITY
    for t in [chosen] if chosen.get("output") is not None else transformations:
        affine = compose(affine, plane(t, list(axes)))
    out = chosen.get("output") or {}
    held = out.get("axes") or list(axes)
    unit = next((a.get("unit") for a in held if str(a.get("name", "")).lower() == "x"), None) or next((a.get("unit") for a in held if a.get("type") == "space"), None)
    return {"affine": affine, "system": out.get("name"), "unit": unit, "micrometres": UNITS.get(unit.lower().strip()) if unit else None, "unsupported": unsupported}


def stable_json(value) -> str:
    """JSON with sorted keys and no spaces: equal values, equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Memo:
    """Results by key, at most so many (the least recently used go), and at most so many bytes if ``size`` is given.

    DataFrames are kept by what they compute: two plans of equal meaning share an entry, which is persisted while it is held."""

    def __init__(self, most: int = 512, most_bytes: int | None = None, size: Callable[[object], int] | None = None):
        self.most, self.most_bytes, self.size = most, most_bytes, size
        self.held: OrderedDict[object, tuple[object, int]] = OrderedDict()
        self.bytes = 0

    def get(self, key, make: Callable[[], object]):
        """The value of a key, made if it is not held. A value larger than all bytes allowed is returned but not held."""
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        value = make()
        n = self.size(value) if self.size else 0
        if self.most_bytes is not None and n > self.most_bytes:
            return value
        self.held[key] = value, n
        self.bytes += n
        while len(self.held) > self.most or (self.most_bytes is not None and self.bytes > self.most_bytes):
            _, (old, m) = self.held.popitem(last=False)
            self.bytes -= m
            if isinstance(old, DataFrame):
                old.unpersist()
        return value

    def frame(self, df: DataFrame) -> DataFrame:
        """The held DataFrame of the same meaning, or this one, persisted."""
        found = next((x for x, _ in self.held.values() if isinstance(x, DataFrame) and x.sameSemantics(df)), None)
        return found if found is not None else self.get((df.semanticHash(), len(self.held)), df.persist)


def resolved(selection: list, load: Callable[[object], object], memo: Memo) -> dict:
    """Values of the selected keys, each loaded once and kept in the memo."""
    return {key: memo.get(key, lambda key=key: load(key)) for key in dict.fromkeys(selection)}
