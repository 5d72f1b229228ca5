"""Statistics of long paths from summaries of their pieces (R-12, W-02, W-06, R-11).

Growth, running high and low, deepest fall and moments of a stretch of returns form a monoid: two summaries side by
side give the summary of both. A bootstrap draw therefore joins a few block summaries instead of copying rows, and a
series that is cut into ranges over many tasks needs one carried row for each range, not one task for the series.
A return of -1 ends the curve: growth stays 0, and the fall is complete even where nothing came before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

PER_YEAR = 252.0


def summary_of(r: Column) -> Column:
    """Of one return. g: growth; hi, lo: extremes of growth so far; fall: least ratio to an earlier or equal high; n, s, q: moments."""
    g = F.greatest(F.lit(0.0), r + 1)
    return F.struct(g.alias("g"), g.alias("hi"), g.alias("lo"), F.when(g > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("fall"), F.lit(1).cast("long").alias("n"), r.alias("s"), (r * r).alias("q"))


def joined(a: Column, b: Column) -> Column:
    """Summary of a stretch `a` followed by `b`."""
    between = F.when(a["hi"] > 0, a["g"] * b["lo"] / a["hi"]).otherwise(F.lit(1.0))
    return F.struct(
        (a["g"] * b["g"]).alias("g"), F.greatest(a["hi"], a["g"] * b["hi"]).alias("hi"), F.least(a["lo"], a["g"] * b["lo"]).alias("lo"),
        F.least(a["fall"], b["fall"], between).alias("fall"), (a["n"] + b["n"]).alias("n"), (a["s"] + b["s"]).alias("s"), (a["q"] + b["q"]).alias("q"),
    )


def folded(summaries: Column) -> Column:
    """Of an array of summaries in order; null for an empty one."""
    return F.when(F.size(summaries) > 0, F.aggregate(F.slice(summaries, 2, F.greatest(F.size(summaries) - 1, F.lit(0))), summaries[0], joined))


def path_columns(s: Column, per_year: float = PER_YEAR) -> list[Column]:
    """total_return, annual_return, sharpe (annual return over annual sample volatility) and max_drawdown of a summary."""
    annual = F.pow(s["g"], F.lit(per_year) / s["n"]) - 1
    var = F.greatest(F.lit(0.0), (s["q"] - s["s"] * s["s"] / s["n"]) / F.when(s["n"] > 1, s["n"] - 1))
    return [(s["g"] - 1).alias("total_return"), annual.alias("annual_return"), F.try_divide(annual, F.sqrt(var) * math.sqrt(per_year)).alias("sharpe"), (s["fall"] - 1).alias("max_drawdown"), s["n"].alias("n")]


def hashed(text: Column, below: Column) -> Column:
    """A number from 0 to below - 1 out of 48 bits of an MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % below


def bootstrap(d: DataFrame, n_boot: int, block: int, seed: int, size: int | None = None, keys: Sequence[str] = ("combo",), order: str = "dt") -> DataFrame:
    """Block bootstrap: (keys, boot) with the path columns of every draw of `size` returns (the whole length by default).

    Each start's block (and the shorter last one) is summarised once; a draw joins ceil(size / block) summaries. A series
    shorter than a block wraps around.
    """
    keys = list(keys)
    n = d.where("r IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pos = d.where("r IS NOT NULL").select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).alias("pos"), "r").join(n, keys)
    # wrapped copies of short series; others stay as they are
    turns = F.when(F.col("n") < block, F.ceil(F.lit(block) / F.col("n")).cast("int")).otherwise(F.lit(0))
    pos = pos.withColumn("turn", F.explode(F.sequence(F.lit(0), turns))).withColumn("pos", F.col("pos") + F.col("turn") * F.col("n"))
    length = F.least(F.lit(size), F.col("n")) if size else F.col("n")
    rest = (length - 1) % block + 1
    ahead = W.partitionBy(*keys).orderBy("pos").rowsBetween(0, block - 1)
    cells = F.collect_list(summary_of(F.col("r"))).over(ahead)
    starts = pos.withColumn("cells", cells).where(F.size("cells") == block)
    starts = starts.select(*keys, F.col("pos").alias("start"), folded(F.col("cells")).alias("whole"), folded(F.slice("cells", 1, rest.cast("int"))).alias("part"))
    starts = cut_lineage(starts)
    draws = n.withColumn("blocks", F.ceil(length / block).cast("int")).withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    draws = draws.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("boot"), F.col("blk"))
    draws = draws.withColumn("start", hashed(text, F.when(F.col("n") < block, F.col("n")).otherwise(F.col("n") - block + 1)))
    piece = F.when(F.col("blk") == F.col("blocks") - 1, F.col("part")).otherwise(F.col("whole"))
    pieces = draws.join(starts, [*keys, "start"]).select(*keys, "boot", F.struct("blk", piece.alias("x")).alias("p"))
    g = pieces.groupBy(*keys, "boot").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # a few summaries a draw
    g = g.select(*keys, "boot", folded(F.transform("ps", lambda p: p["x"])).alias("x"))
    return g.select(*keys, "boot", *path_columns(F.col("x")))


# ---------------------------------------------------------------- scans over ranges


def in_ranges(d: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """`d` cut into ranges of (keys, order), settled, with the range number `__part`: a long series lies in many of them."""
    parts = parts or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(d.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()))


def scan(laid: DataFrame, keys: Sequence[str], order: Sequence[str], outs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running values of `outs` (name: how, value) along `order` inside `keys`; `laid` comes from `in_ranges`.

    How: 'sum', 'max', 'min' up to and including the row, 'last' the value of the row before. Each range is scanned by
    itself; one row for each (key, range) carries what came before.
    """
    keys, order = list(keys), list(order)
    here = W.partitionBy(*keys, "__part").orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    local, ends, carry, out = [], [], [], []
    for name, (how, value) in outs.items():
        end, before = f"__e_{name}", f"__b_{name}"
        if how == "last":
            local.append(F.lag(value).over(here).alias(name))
            ends.append(F.max_by(value, F.struct(*order)).alias(end))
            carry.append(F.last(end).over(earlier).alias(before))
            out.append(F.when(F.col("__first"), F.col(before)).otherwise(F.col(name)).alias(name))
            continue
        local.append(fold[how](value).over(upto).alias(name))
        ends.append(fold[how](value).alias(end))
        carry.append(fold[how](end).over(earlier).alias(before))
        both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[how]
        out.append(both(F.col(name), F.col(before)).alias(name))
    ranges = laid.groupBy(*keys, "__part").agg(*ends)
    carried = ranges.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), *carry)
    rows = laid.select("*", *local, (F.row_number().over(here) == 1).alias("__first"))
    on = F.col("__part") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(carried, on).select(*laid.columns, *out)


def running_drawdown(d: DataFrame, keys: Sequence[str] = ("combo",), order: Sequence[str] = ("dt",), parts: int | None = None) -> DataFrame:
    """Adds eq (growth of 1), high (its running maximum) and dd (fall below it) to rows with a return `r`."""
    laid = in_ranges(d, keys, order, parts)
    gone = (F.col("r") <= -1).cast("int")
    laid = scan(laid, keys, order, {"__log": ("sum", F.when(F.col("r") > -1, F.log1p("r")).otherwise(F.lit(0.0))), "__gone": ("sum", gone)})
    laid = cut_lineage(laid.withColumn("eq", F.when(F.col("__gone") > 0, F.lit(0.0)).otherwise(F.exp("__log"))).drop("__log", "__gone"))
    out = scan(laid, keys, order, {"high": ("max", F.col("eq"))})
    return cut_lineage(out.withColumn("dd", F.when(F.col("high") > 0, F.col("eq") / F.col("high") - 1).otherwise(F.lit(-1.0))))


def drawdowns(curves: DataFrame, keys: Sequence[str] = ("combo",), limit: float = -0.05, order: str = "dt") -> DataFrame:
    """Falls below `limit` of `running_drawdown` rows: peak, first row below the limit's side, trough, recovery, depth and bars between.

    A fall lasts from the peak to the row that reaches it again; `recovery` is null where none does.
    """
    keys = list(keys)
    d = scan(curves, keys, [order], {"run": ("sum", (F.col("dd") >= 0).cast("int")), "bar_no": ("sum", F.lit(1))})
    d = cut_lineage(d.select(*keys, order, "dd", "run", "bar_no"))
    peak = d.where("dd >= 0").select(*keys, "run", F.col(order).alias("peak"), F.col("bar_no").alias("peak_no"))
    low = F.struct("dd", order)
    falls = d.where("dd < 0").groupBy(*keys, "run").agg(
        F.min("dd").alias("depth"), F.min_by(order, low).alias("trough"), F.min_by("bar_no", low).alias("trough_no"), F.max("bar_no").alias("last_no"), F.min(F.when(F.col("dd") < limit, F.col(order))).alias("below")
    ).where("below IS NOT NULL")
    after = peak.select(*keys, (F.col("run") - 1).alias("run"), F.col("peak").alias("recovery"), F.col("peak_no").alias("recovery_no"))
    f = falls.join(peak, [*keys, "run"]).join(after, [*keys, "run"], "left")
    return f.select(*keys, "peak", "below", "trough", "recovery", "depth", (F.col("trough_no") - F.col("peak_no")).alias("bars_down"), (F.col("recovery_no") - F.col("trough_no")).alias("bars_up"), (F.col("last_no") - F.col("peak_no")).alias("bars_under"))


def streaks(d: DataFrame, keys: Sequence[str], order: Sequence[str], kind: Column, parts: int | None = None) -> DataFrame:
    """(keys, kind, length, first): runs of rows of one kind along `order`; a null kind is a kind of its own."""
    keys, order = list(keys), list(order)
    laid = in_ranges(d.select(*keys, *order, F.coalesce(kind.cast("string"), F.lit("")).alias("kind")), keys, order, parts)
    laid = cut_lineage(scan(laid, keys, order, {"__before": ("last", F.col("kind"))}))
    new = (~F.col("kind").eqNullSafe(F.col("__before"))).cast("int")
    runs = scan(laid, keys, order, {"__run": ("sum", new)})
    return runs.groupBy(*keys, "__run", "kind").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct(*order)).alias("first")).drop("__run")
