"""F-01..F-38: one query per factor of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.factors import BAR_FACTORS, factors_wide
from ..oracle import factors as O
from ..sources.panel import panel
from .registry import query, rounded


def _add(i: int, name: str) -> None:
    sql = O.one(name) if name in O.SQL else O.STEPPED.get(name)

    @query(f"f_{i:02d}_{name.lower()}", sql)
    def run(spark, sf, name=name):
        d = factors_wide(panel(spark, sf), [name])
        return rounded(d.select("symbol", "dt", F.col(name).alias("value")).where("value is not null"))


for _i, _name in enumerate(BAR_FACTORS, start=1):
    _add(_i, _name)
