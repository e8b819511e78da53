"""Tests of significance. Counts are aggregates; tails are sums in log space over small tables."""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .metrics import right, wide


def log_choose(n: Column, k: Column) -> Column:
    """ln C(n, k) as a sum of logarithms."""
    terms = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), k)), lambda i: F.when(i <= k, F.ln((n - k + i) / i)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """min(1, 2 P(X <= min(b, c))), X being Binomial(b + c, 1/2); 1 if b + c is 0."""
    n, k = (b + c).cast("double"), F.least(b, c)
    # terms follow from one another: t(i+1) = t(i) (n - i) / (i + 1)
    step = lambda a, i: F.struct((a["s"] + F.exp(a["t"])).alias("s"), (a["t"] + F.ln(F.greatest((n - i) / (i + 1), F.lit(1e-300)))).alias("t"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.struct(F.lit(0.0).alias("s"), (-n * math.log(2)).alias("t")), step, lambda a: a["s"])
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def holm(df: DataFrame, p: str = "p_value", order: list[str] | None = None) -> DataFrame:
    """p_holm: the running maximum of (m - rank) p, at most 1. For tables of a few comparisons."""
    w = Window.partitionBy().orderBy(p, *(order or []))
    rank = F.row_number().over(w) - 1
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy()) - rank) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def mcnemar(preds: DataFrame, models: list[str]) -> DataFrame:
    """Exact McNemar tests of all pairs of models with Holm's correction and a verdict."""
    w = wide(preds, right(), models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    row = w.agg(*[F.count_if(F.col(x) & ~F.col(y)).alias(f"{x}|{y}") for a, b in pairs for x, y in ((a, b), (b, a))])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}|{b}`").alias("only_a_right"), F.col(f"`{b}|{a}`").alias("only_b_right")) for a, b in pairs]))
    t = row.select(each.alias("x")).select("x.*").withColumn("p_value", binomial_two_sided(F.col("only_a_right"), F.col("only_b_right")))
    t = holm(t, "p_value", ["model_a", "model_b"])
    better = F.concat(F.when(F.col("only_a_right") > F.col("only_b_right"), F.col("model_a")).otherwise(F.col("model_b")), F.lit(" better"))
    return t.withColumn("significant", F.col("p_holm") < 0.05).withColumn("result", F.when(F.col("significant"), better).otherwise("no significant difference"))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P of a chi-squared value with one degree of freedom or more."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v is not None and v == v and v >= 0 else None)


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """Odds ratio, statistic (with correction) and p over rows (a, b, c, d) of 2x2 tables."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    t = tables.withColumn("n", a + b + c + d).where("n >= 2")
    n = F.col("n")
    s = t.agg(F.sum(a * d / n).alias("num"), F.sum(b * c / n).alias("den"), F.sum(a - (a + b) * (a + c) / n).alias("dev"), F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("var"))
    stat = F.coalesce(F.try_divide(F.pow(F.abs("dev") - 0.5, 2), F.col("var")), F.lit(0.0))
    out = s.select(F.when(F.col("den") == 0, F.lit(math.inf)).otherwise(F.try_divide(F.col("num"), F.col("den"))).alias("odds_ratio"), stat.alias("statistic"))
    return out.withColumn("p_value", chi2_tail("statistic"))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: all tables of these margins that are no likelier than this one."""
    lg = math.lgamma
    row, col, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        ys = (x, row - x, col - x, n - row - col + x)
        return lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1) - sum(lg(y + 1) for y in ys)

    own = log_p(a)
    return min(1.0, sum(math.exp(v) for x in range(max(0, row + col - n), min(row, col) + 1) if (v := log_p(x)) <= own + 1e-7))


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*map(int, t)) for t in zip(a, b, c, d, strict=True)])


def fisher(tables: DataFrame) -> DataFrame:
    """tables with odds_ratio (infinite if b c is 0) and p_value."""
    a, b, c, d = (F.col(x) for x in "abcd")
    ratio = F.when(b * c == 0, F.when(a * d == 0, F.lit(math.nan)).otherwise(F.lit(math.inf))).otherwise(F.try_divide((a * d).cast("double"), (b * c).cast("double")))
    return tables.withColumn("odds_ratio", ratio).withColumn("p_value", _fisher("a", "b", "c", "d"))


def mean_nll(temperature: Column, logits: list[str] = ("z0", "z1", "z2"), label: str = "label") -> Column:
    z = [F.col(c) / temperature for c in logits]
    top = F.greatest(*z)
    total = sum(F.exp(x - top) for x in z)
    own = F.get(F.array(*z), F.col(label))
    return F.avg(F.ln(total) + top - own)


def temperature_grid(df: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, nll) of each temperature: one pass, an aggregate each."""
    row = df.agg(*[mean_nll(F.lit(float(t))).alias(f"t{i}") for i, t in enumerate(grid)])
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)]))
    return row.select(each.alias("x")).select("x.*")


LOG_RANGE = (math.log(0.05), math.log(20.0))  # of the temperatures that are tried


def temperature_slopes(df: DataFrame, log_t: float, logits: list[str] = ("z0", "z1", "z2"), label: str = "label") -> tuple[float, float]:
    """The first and second derivative of the mean negative log likelihood by ln T, in one aggregate.

    With u = 1 / T the slope by u is the mean of E[z] - z(label), the curvature the mean variance of z,
    both under the scaled softmax; the chain rule for u = exp(-ln T) does the rest.
    """
    u = math.exp(-log_t)
    z = [F.col(c).cast("double") for c in logits]
    top = F.greatest(*z)
    e = [F.exp((x - top) * u) for x in z]
    total = sum(e[1:], e[0])
    mean = sum((w * x for w, x in zip(e[1:], z[1:], strict=True)), e[0] * z[0]) / total
    square = sum((w * x * x for w, x in zip(e[1:], z[1:], strict=True)), e[0] * z[0] * z[0]) / total
    row = df.agg(F.avg(mean - F.get(F.array(*z), F.col(label))).alias("g"), F.avg(square - mean * mean).alias("h")).first()
    g, h = row["g"] or 0.0, row["h"] or 0.0
    return -u * g, u * u * h + u * g


def fit_temperature(df: DataFrame, passes: int = 10, near: float = 1e-9, logits: list[str] = ("z0", "z1", "z2"), label: str = "label") -> float:
    """The temperature of least mean negative log likelihood: Newton steps on its logarithm, each a pass
    over the rows. Steps stay between the points known to lie on either side of the least value (halving
    what is left where a step would leave them); no rows, or equal logits, give 1."""
    low, high = LOG_RANGE
    x, last, slow = 0.0, 0.0, 0
    for _ in range(passes):
        slope, curve = temperature_slopes(df, x, logits, label)
        if slope == 0:
            break
        low, high = (low, x) if slope > 0 else (x, high)
        step = x - slope / curve if curve > 0 else math.nan
        slow += (step - x) * last > 0 and abs(step - x) > abs(last) / 2
        if not low < step < high or slow == 2:  # it leaves what is left, or does not close in
            slow = 0
            limit = LOG_RANGE[0] if slope > 0 else LOG_RANGE[1]
            step = limit if x != limit and limit in (low, high) else (low + high) / 2
        if abs(step - x) < near:
            return math.exp(step)
        x, last = step, step - x
    return math.exp(x)


def calibration_table(df: DataFrame, temperature: float, logits: list[str] = ["z0", "z1", "z2"]) -> DataFrame:  # noqa: B006
    """n, accuracy, Brier score and log loss before and after scaling by the temperature."""
    from ..functions.scalars import argmax, softmax
    from .metrics import brier, log_loss

    out = None
    for stage, t in (("before", 1.0), ("after", temperature)):
        p = df.select("label", *[x.alias(f"p{k}") for k, x in enumerate(softmax([F.col(c) for c in logits], t))])
        one = p.agg(F.lit(stage).alias("stage"), F.lit(float(t)).alias("temperature"), F.count(F.lit(1)).alias("n"), F.avg((argmax([F.col(f"p{k}") for k in range(3)]) == F.col("label")).cast("int")).alias("accuracy"), brier().alias("brier"), log_loss().alias("log_loss"))
        out = one if out is None else out.unionByName(one)
    return out
