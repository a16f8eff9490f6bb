"""Price on score: the position-aware fit and the fair-value line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import clean_double, to_number
from ..session import c, small_side
from .ranking import average_percent, with_rank


def positive_value(df: DataFrame, value="market_value_eur") -> DataFrame:
    kind = dict(df.dtypes)[value]
    v = to_number(c(value)) if kind == "string" else clean_double(c(value))
    return df.withColumn(value, v).where(c(value) > 0)


def fit_by_position(df: DataFrame, score="scout_score", value="market_value_eur", pos="Pos") -> DataFrame:
    """Least squares of log10(value) on score plus one intercept per position.

    The closed form needs only four moments per position: the common slope is
    the pooled within-position Sxy over Sxx. One row per position.
    """
    x, y = F.coalesce(c(score), F.lit(0.0)), F.log10(c(value))
    whole = Window.partitionBy()  # over one row per position
    moments = df.groupBy(c(pos)).agg(
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    sxx, sxy = F.sum("_sxx").over(whole), F.sum("_sxy").over(whole)
    return moments.select(
        c(pos),
        "mean_x",
        "mean_y",
        F.when(sxx > 0, sxy / F.nullif(sxx, F.lit(0.0))).otherwise(0.0).alias("slope"),
    )


def undervaluation(df: DataFrame, score="scout_score", value="market_value_eur", pos="Pos") -> DataFrame:
    """Residuals of the fit, their percent rank (100 = cheapest for the output) and the gap."""
    pool = positive_value(df, value)
    model = small_side(fit_by_position(pool, score, value, pos))
    x = F.coalesce(c(score), F.lit(0.0))
    fitted = (
        pool.join(model, pos)
        .withColumn("predicted_log_mv", F.col("mean_y") + F.col("slope") * (x - F.col("mean_x")))
        .withColumn("predicted_mv_eur", F.pow(F.lit(10.0), F.col("predicted_log_mv")))
        .withColumn("residual", F.log10(c(value)) - F.col("predicted_log_mv"))
        .withColumn("value_gap_eur", F.col("predicted_mv_eur") - c(value))
        .withColumn("_cheap", -F.round("residual", 9))
        .drop("mean_x", "mean_y", "slope")
    )
    return with_rank(fitted, "_cheap", "uv_score", average_percent).drop("_cheap")


def fair_value_line(df: DataFrame, score="scout_score", value="market_value_eur", points: int = 200) -> DataFrame:
    """Plain fit of log10(value in millions) on score, evaluated over 0..100.

    Needs two rows at least; the line is empty below that.
    """
    pool = df.where(c(score).isNotNull() & (c(value) > 0))
    y = F.log10(c(value) / 1_000_000)
    line = pool.agg(
        F.regr_slope(y, c(score)).alias("slope"),
        F.regr_intercept(y, c(score)).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    ).where("n >= 2")
    at = F.col("i") * 100.0 / (points - 1)
    return line.select(
        "slope", "intercept", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    ).select(
        "i",
        at.alias("score"),
        F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * at).alias("fair_value_m"),
    )
