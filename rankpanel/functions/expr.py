"""Scalar expressions (E-01..E-11). NULL stands for the missing value everywhere; NaN never leaves a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(x, y, eps: float = EPS) -> Column:
    """x/(y+eps), NULL where y < eps."""
    x, y = col(x), col(y)
    return F.when(y >= eps, x / (y + F.lit(eps)))


def safe_div_signed(x, y, eps: float = EPS) -> Column:
    """x/(|y|+eps), NULL where |y| <= eps (change ratios on a base that may be negative)."""
    x, y = col(x), col(y)
    return F.when(F.abs(y) > eps, x / (F.abs(y) + F.lit(eps)))


def ratio(x, y) -> Column:
    """x/y, NULL where y is 0."""
    x, y = col(x), col(y)
    return F.when(y != 0, x / y)


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip that keeps NULL (greatest/least alone would return the bound)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def both(op, a, b) -> Column:
    """Apply `op` only where both inputs are present."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), op(a, b))


def binary(op: str, a, b) -> Column:
    """The six pairwise operations of factor algebra."""
    a, b = col(a), col(b)
    if op == "add":
        return a + b
    if op == "sub":
        return a - b
    if op == "mul":
        return a * b
    if op == "div":
        return ratio(a, b)
    if op == "max":
        return both(F.greatest, a, b)
    if op == "min":
        return both(F.least, a, b)
    raise ValueError(f"unknown operation {op!r}")


ALGEBRA = ("add", "sub", "mul", "div", "max", "min")


def unary(op: str, x) -> Column:
    """Element-wise transforms of a factor (the rank transform needs a window and lives in ranking)."""
    x = col(x)
    if op == "log1p":
        return F.signum(x) * F.log1p(F.abs(x))
    if op == "sqrt":
        return F.signum(x) * F.sqrt(F.abs(x))
    if op == "sign":
        return F.signum(x)
    if op == "abs":
        return F.abs(x)
    raise ValueError(f"unknown transform {op!r}")


TRANSFORMS = ("log1p", "sqrt", "sign", "abs")


def ladder(x, steps: Sequence[tuple[float, float]], base: float = 1.0) -> Column:
    """Threshold ladder: the highest threshold reached decides."""
    x = col(x)
    out = None
    for threshold, level in sorted(steps, reverse=True):
        out = F.when(x >= threshold, F.lit(level)) if out is None else out.when(x >= threshold, F.lit(level))
    return F.lit(base) if out is None else out.otherwise(F.lit(base))


def position_count(exposure, zones: Sequence[tuple[float, int]], lowest: int = 1, cap: int = 4) -> Column:
    """Exposure to number of positions: the first zone whose ceiling holds it (else the last), clamped."""
    e = col(exposure)
    out = None
    for ceiling, size in sorted(zones):
        out = F.when(e <= ceiling, F.lit(size)) if out is None else out.when(e <= ceiling, F.lit(size))
    return F.least(F.greatest(out.otherwise(F.lit(sorted(zones)[-1][1])), F.lit(lowest)), F.lit(cap))


def names_of(combo) -> Column:
    """'A + B + C' to ['A','B','C']."""
    return F.transform(F.split(col(combo), r"\+"), lambda n: F.trim(n))


def combo_of(names) -> Column:
    return F.array_join(col(names), " + ")


def parents_of(name) -> Column:
    """'A__op__B' to [A, B]; a plain name is its own parent."""
    parts = F.split(col(name), "__")
    return F.when(F.size(parts) == 3, F.array(parts[0], parts[2])).otherwise(F.array(parts[0]))


def lots(value, price, lot: int = 100) -> Column:
    """Shares that `value` buys, rounded down to whole lots."""
    v, p = col(value), col(price)
    return F.when(p > 0, F.floor(F.floor(v / p) / F.lit(lot)) * F.lit(lot))


def nearest(x, centres: dict[str, float]) -> Column:
    """Label of the closest centre (ties by name)."""
    x = col(x)
    options = F.array(*[F.struct(F.abs(x - F.lit(v)).alias("gap"), F.lit(k).alias("name")) for k, v in centres.items()])
    return F.when(x.isNotNull(), F.array_min(options)["name"])


def stars(p) -> Column:
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def compound(r) -> Column:
    """Aggregate: compounded return of simple returns."""
    return F.exp(F.sum(F.log1p(col(r)))) - F.lit(1.0)


def null_nan(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def corr(a, b) -> Column:
    """Aggregate: correlation over rows where both are present, NULL when a side is flat.

    The built-in `corr` divides by zero on a flat side, which is an error in ANSI mode.
    """
    a, b = col(a), col(b)
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def corr_over(a, b, w) -> Column:
    """The same over a window."""
    a, b = col(a), col(b)
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    return F.try_divide(F.covar_pop(x, y).over(w), F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w)))
