"""Ranking, gating and choosing combinations (C-13..C-22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import corr
from ..functions.ranking import quantiles, ranked
from ..session import cut_lineage


def rank_scores(d: DataFrame, parts: Sequence[tuple[str, float, bool]], out: str, mode: str = "unit", key: str = "combo") -> DataFrame:
    """Weighted sum of rank-normalised columns over the whole table.

    mode 'unit': (rank-1)/(n-1); 'pct': rank/n; 'rank': the rank itself. The flag says whether high is
    good. Ranks come from the size-checked ranking, so the table is never forced into one task.
    """
    n = d.count()
    score = F.lit(0.0)
    for i, (c, weight, high) in enumerate(parts):
        r = ranked(d.select(key, c), c, f"__r{i}", tie=key, descending=(mode == "rank" and high), average=True).select(key, f"__r{i}")
        d = d.join(r, key, "left")
        x = F.col(f"__r{i}")
        if mode == "unit":
            u = (x - 1) / F.lit(max(n - 1, 1))
            u = u if high else 1 - u
        elif mode == "pct":
            u = x / F.lit(n)
            u = u if high else 1 - u
        else:
            u = x
        score = score + F.lit(weight) * u
    return d.withColumn(out, score).drop(*[f"__r{i}" for i in range(len(parts))])


def with_quantiles(d: DataFrame, columns: Sequence[tuple[str, float]], key: str = "combo") -> DataFrame:
    """Adds table-wide quantiles as columns (one row of numbers, joined to every row)."""
    for i, (c, p) in enumerate(columns):
        q = quantiles(d.select(key, c), c, [p], tie=key).withColumnRenamed("q0", f"{c}_q{i}")
        d = d.crossJoin(F.broadcast(q))  # a single row
    return d


def grades(d: DataFrame, score: str, key: str = "combo", cuts: Sequence[tuple[float, str]] = ((0.1, "A"), (0.3, "B"), (0.6, "C")), rest: str = "D") -> DataFrame:
    """Letter by position in the table (lower score is better)."""
    n = d.count()
    r = ranked(d, score, "__pos", tie=key)
    out = None
    for share, letter in cuts:
        cond = F.col("__pos") <= int(n * share)
        out = F.when(cond, letter) if out is None else out.when(cond, letter)
    return r.withColumn("grade", out.otherwise(rest)).drop("__pos")


def jaccard_to(d: DataFrame, names: str, chosen: list[list[str]]) -> Column:
    """Largest Jaccard similarity of a row's factor set to the sets chosen so far (a short list of literals)."""
    sims = []
    for c in chosen:
        s = F.array(*[F.lit(x) for x in c])
        sims.append(F.size(F.array_intersect(names, s)) / F.size(F.array_union(names, s)).cast("double"))
    return F.greatest(*sims, F.lit(0.0), F.lit(0.0))


def diverse_top(d: DataFrame, score: str, k: int, limit: float = 0.6) -> list[dict]:
    """Greedy: best row, then best row not too similar to any chosen one. k short scans; k rows reach the driver."""
    chosen: list[dict] = []
    for _ in range(k):
        left = d.where(~F.col("combo").isin([c["combo"] for c in chosen])) if chosen else d
        if chosen:
            left = left.where(jaccard_to(left, "names", [c["names"] for c in chosen]) <= limit)
        best = left.orderBy(F.desc(score), "combo").select("combo", "names", score).limit(1).collect()
        if not best:
            break
        chosen.append({"combo": best[0]["combo"], "names": list(best[0]["names"]), score: best[0][score]})
    return chosen


def basket(d: DataFrame, returns: DataFrame, score: str, k: int, w_corr: float, w_overlap: float, max_overlap: float, max_corr: float | None) -> list[dict]:
    """Greedy basket: score - w1 x mean |corr| - w2 x largest overlap, with hard limits on both.

    Each round correlates all candidates with the one row chosen last (a join on the period, not all
    pairs) and adds it to running sums per candidate.
    """
    spark = d.sparkSession
    first = d.orderBy(F.desc(score), "combo").select("combo", "names", score).limit(1).collect()
    if not first:
        return []
    picks = [{"combo": first[0]["combo"], "names": list(first[0]["names"]), "objective": first[0][score]}]
    state = cut_lineage(d.select("combo", "names", score, F.lit(0.0).alias("sum_c"), F.lit(0.0).alias("max_c")))
    for _ in range(k - 1):
        last = returns.where(F.col("combo") == picks[-1]["combo"]).select("period", F.col("net").alias("base"))
        c = returns.join(last, "period").groupBy("combo").agg(F.abs(corr("net", "base")).alias("c"))
        state = state.join(c, "combo", "left").select(
            "combo", "names", score, (F.col("sum_c") + F.coalesce("c", F.lit(0.0))).alias("sum_c"), F.greatest("max_c", F.coalesce("c", F.lit(0.0))).alias("max_c")
        )
        state = cut_lineage(state)
        left = state.where(~F.col("combo").isin([p["combo"] for p in picks]))
        left = left.withColumn("ov", jaccard_to(left, "names", [p["names"] for p in picks])).withColumn("avg_c", F.col("sum_c") / len(picks))
        if max_corr is not None:
            left = left.where(F.col("max_c") <= max_corr)
        hard = left.where(F.col("ov") <= max_overlap).withColumn("objective", F.round(F.col(score) - w_corr * F.col("avg_c") - w_overlap * F.col("ov"), 10))
        best = hard.orderBy(F.desc("objective"), "combo").limit(1).collect()
        if not best:  # relax the overlap limit only
            soft = left.withColumn("objective", F.round(F.col(score) - w_corr * F.col("avg_c"), 10))
            best = soft.orderBy(F.desc("objective"), "combo").limit(1).collect()
        if not best:
            break
        picks.append({"combo": best[0]["combo"], "names": list(best[0]["names"]), "objective": best[0]["objective"]})
    return picks


def chosen_frame(spark, rows: list[dict], value: str) -> DataFrame:
    data = [(i + 1, r["combo"], float(r[value])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"pick int, combo string, {value} double")


def subset_scores(items: DataFrame, k: int, w_factors: float, w_picks: float) -> DataFrame:
    """Every k-subset of a short list: mean quality minus weighted mean pairwise similarity of factors and picks.

    `items` (combo, quality, names, picks) is the shortlist the caller wants scored exhaustively.
    """
    it = items.select(F.struct("combo", "quality", "names", "picks").alias("x"))
    cur = it.select(F.array("x").alias("xs"))
    for _ in range(k - 1):
        cur = cur.join(it, F.col("x.combo") > F.element_at("xs", -1)["combo"]).select(F.concat("xs", F.array("x")).alias("xs"))

    def sim(field):
        pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
        tot = F.lit(0.0)
        for i, j in pairs:
            a, b = F.col("xs")[i][field], F.col("xs")[j][field]
            tot = tot + F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
        return tot / len(pairs)

    d = cur.select(
        F.array_join(F.transform("xs", lambda x: x["combo"]), " | ").alias("combos"),
        (F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["quality"]) / k).alias("quality"),
        sim("names").alias("avg_jaccard_factors"),
        sim("picks").alias("avg_jaccard_picks"),
    )
    return d.withColumn("total_score", F.col("quality") - w_factors * F.col("avg_jaccard_factors") - w_picks * F.col("avg_jaccard_picks"))


def calibrate(d: DataFrame, key: str, features: Sequence[str], target: str, model: str = "ridge", folds: int = 5, seed: int = 42):
    """Learned re-ranking with MLlib: impute the median, scale, fit ridge or boosted trees with cross-validation.

    Folds go round the rows in the order of a hash of their key: they are even, and do not hang on partitions.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    filled = [f"{f}__f" for f in features]
    imp = Imputer(strategy="median", inputCols=list(features), outputCols=filled)
    vec = VectorAssembler(inputCols=filled, outputCol="__raw")
    scale = StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="features")
    if model == "ridge":
        reg = LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=0.0)
        grid = ParamGridBuilder().addGrid(reg.regParam, [0.01, 0.1, 1.0]).build()
    else:
        reg = GBTRegressor(featuresCol="features", labelCol=target, maxDepth=3, maxIter=20, seed=seed)
        grid = ParamGridBuilder().build()
    pipe = Pipeline(stages=[imp, vec, scale, reg])
    placed = cut_lineage(ranked(d.withColumn("__hash", F.xxhash64(key, F.lit(seed))), "__hash", "__place", tie=key))
    folds = max(2, min(folds, placed.count()))  # no fold without a row
    placed = placed.withColumn("__fold", (F.col("__place") % folds).cast("int")).drop("__hash", "__place")
    cv = CrossValidator(
        estimator=pipe, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"), numFolds=folds, foldCol="__fold", seed=seed, parallelism=2
    )
    fitted = cv.fit(placed)
    return fitted, fitted.transform(d).drop("__raw", "features", *filled)
