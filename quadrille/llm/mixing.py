"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources in code-point order, null last, weigh ``WEIGHTS`` in turn and share ``percent`` of all words. A source is
served its documents in a shuffled order, again and again, at most ``REPEATS`` times; a copy's virtual finish time
is the source's words served up to its middle, divided by the source's weight. All copies are put in the order
of that time, and the mix ends at the time when the budget is spent: sources that have run out by then stay at
``REPEATS`` times their size, and the others share the rest by weight. That time follows from the sizes of the
sources alone, so no running total over the whole mix is needed.

Running totals inside a source are taken in buckets of the shuffled order, whose number follows the rows, plus the
totals of the buckets before; a hot source is spread over its buckets.

Defined results: a null text has no words and is never taken. Rows with equal ids and texts are taken one by one.
No documents: no rows. The shuffle is the order of md5(doc_id), so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.checkpoints import saved

WEIGHTS, REPEATS = (5, 2, 1), 3
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Adds _size (words), _src (source, null as empty), _nosrc, _h (shuffle key)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": size, "_src": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_nosrc": F.col(source_col).isNull().cast("int"), "_h": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))})


def shares(sizes: DataFrame, percent: int = 100) -> DataFrame:
    """Per source (_src, _nosrc): _s (words), _rows, _w, _level, _target. One row for each source."""
    totals = sizes.groupBy("_src", "_nosrc").agg(F.sum("_size").alias("_s"), F.count("*").alias("_rows"))
    place = F.row_number().over(Window.orderBy("_nosrc", "_src")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = totals.withColumn("_w", weight)
    # a source whose limit divided by weight is the least runs out first; the first level that its source does not
    # reach is the one, and those after it are no higher
    before = Window.orderBy(F.col("_s") * REPEATS / F.col("_w"), "_nosrc", "_src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("_s").over(every) * percent / 100 - F.coalesce(F.sum(F.col("_s") * REPEATS).over(before), F.lit(0))
    level = left / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    ranked = ranked.withColumn("_try", level).withColumn("_ratio", F.col("_s") * REPEATS / F.col("_w"))
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_try") <= F.col("_ratio"), F.col("_try"))).over(every))
    full = F.coalesce(F.col("_ratio") < F.col("_level"), F.lit(True))
    return ranked.select("_src", "_nosrc", "_s", "_rows", "_w", F.coalesce("_level", F.lit(float("inf"))).alias("_level"), F.when(full, (F.col("_s") * REPEATS).cast("double")).otherwise(F.col("_w") * F.col("_level")).alias("_target"))


def _planned(rows: DataFrame, percent: int, id_col: str) -> DataFrame:
    """Adds to sized rows their source's figures, _finish (of the first copy) and _copies."""
    slim = saved(rows.select("_src", "_nosrc", "_size", "_h"))
    parts = saved(shares(slim, percent))
    most = parts.agg(F.max("_rows")).first()[0] or 1
    digits = 0
    while 16**digits * BUCKET_ROWS < most and digits < 12:
        digits += 1
    bucket = F.substring("_h", 1, digits)
    sums = slim.groupBy("_src", "_nosrc", bucket.alias("_b")).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_src", "_nosrc").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(parts, ["_src", "_nosrc"])
    held = rows.withColumn("_b", bucket).join(sums, ["_src", "_nosrc", "_b"])
    inside = Window.partitionBy("_src", "_nosrc", "_b").orderBy("_h", F.col(id_col), "_size").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_at", 2 * (F.col("_before") + F.sum("_size").over(inside)) - F.col("_size"))
    finish = lambda e: (F.col("_at") + 2 * e * F.col("_s")) / (2 * F.col("_w"))
    copies = sum((F.when((F.col("_size") > 0) & (finish(e) <= F.col("_level")), 1).otherwise(0) for e in range(1, REPEATS)), F.when((F.col("_size") > 0) & (finish(0) <= F.col("_level")), 1).otherwise(0))
    return held.withColumn("_finish", finish(0)).withColumn("_copies", copies)


def mix_counts(docs: DataFrame, percent: int = 100, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document, in the order of virtual finish times: its id, size, source_size, target, taken, virtual_finish."""
    rows = sized(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)), id_col, text_col, source_col).drop(text_col, source_col)
    plan = _planned(rows, percent, id_col)
    out = plan.select(F.col(id_col), F.col("_size").alias("size"), F.col("_s").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_finish").alias("virtual_finish"))
    return out.orderBy("virtual_finish", id_col)


def mix(docs: DataFrame, percent: int = 100, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in the order of virtual finish times.

    mix_copy counts a document's copies from 0; mix_finish is the copy's time."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id_col, text_col, source_col)}
    plan = _planned(sized(docs.toDF(*names), at[id_col], at[text_col], at[source_col]), percent, at[id_col])
    copies = plan.where("_copies > 0").withColumn("_e", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    copies = copies.withColumn("_t", F.col("_finish") + F.col("_e") * F.col("_s") / F.col("_w"))
    return copies.orderBy("_t", at[id_col]).select(*names, F.col("_e").cast("int"), "_t").toDF(*docs.columns, "mix_copy", "mix_finish")


#: DuckDB SQL of mix_counts over the table documents.
MIX_SQL = r"""
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, coalesce(source, '') as src, (source is null)::int as nosrc, md5(coalesce(doc_id::varchar, '')) as h from documents),
t as (select src, nosrc, sum(size)::bigint as s from d group by 1, 2),
w as (select *, [5, 2, 1][((row_number() over (order by nosrc, src) - 1) % 3 + 1)::int]::bigint as w from t),
r as (select *, (s * 3)::double / w as ratio from w),
b as (select *, (sum(s) over ()::double * 100 / 100 - coalesce(sum(s * 3) over (order by ratio, nosrc, src rows between unbounded preceding and 1 preceding), 0)::double) / (sum(w) over () - coalesce(sum(w) over (order by ratio, nosrc, src rows between unbounded preceding and 1 preceding), 0))::double as try from r),
l as (select *, max(case when try <= ratio then try end) over () as level from b),
p as (select src, nosrc, s, w, coalesce(level, 'infinity'::double) as level, case when coalesce(ratio < level, true) then (s * 3)::double else w * level end as target from l),
c as (select d.*, p.s, p.w, p.level, p.target, 2 * sum(size) over (partition by d.src, d.nosrc order by h, doc_id nulls first, size rows between unbounded preceding and current row) - size as "at" from d join p on d.src = p.src and d.nosrc = p.nosrc)
select doc_id, size, s as source_size, target, (case when size > 0 then size * (("at"::double / (2 * w) <= level)::int + (("at" + 2 * s)::double / (2 * w) <= level)::int + (("at" + 4 * s)::double / (2 * w) <= level)::int) else 0 end)::bigint as taken, "at"::double / (2 * w) as virtual_finish from c
"""
