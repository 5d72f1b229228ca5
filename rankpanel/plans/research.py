"""Stages shared by the research queries: factor tables, standardised factors, the daily rank statistic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.rolling import lead
from ..operators.cross_section import standardise
from ..operators.factors import CATALOG, factors_wide, to_long
from ..operators.quality import rank_ic
from ..oracle.research import HOR, NAMES
from ..sources.panel import panel
from ..sources.stages import stage

BOUNDED = tuple(n for n in NAMES if CATALOG[n].bounded)
FWD = tuple(f"fwd{h}" for h in HOR)
IDS = ("dt", "symbol", "bar", "pool", "r", "close", *FWD)


def with_forward(d):
    return d.select("*", *[(ratio(lead("close", h), "close") - 1).alias(f"fwd{h}") for h in HOR])


def raw_wide(spark, sf, kind="brand"):
    return stage(spark, sf, f"raw_wide:{kind}", lambda: with_forward(factors_wide(panel(spark, sf, kind), NAMES, keep=("r", "close"))))


def std_wide(spark, sf, kind="brand"):
    return stage(spark, sf, f"std_wide:{kind}", lambda: standardise(raw_wide(spark, sf, kind), NAMES, BOUNDED))


def raw_long(spark, sf):
    return to_long(raw_wide(spark, sf), NAMES, IDS)


def std_long(spark, sf, kind="brand"):
    return to_long(std_wide(spark, sf, kind), NAMES, IDS)


def daily_ic(spark, sf):
    return stage(spark, sf, "daily_ic", lambda: rank_ic(std_long(spark, sf), "fwd1", ("factor", "dt")))
