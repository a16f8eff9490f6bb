"""Market values and expected goals attached by name, exact first, then fuzzy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import FUZZY_THRESHOLD, FUZZY_THRESHOLD_CLUB, MATCH_RATE_WARNING, TOKEN_SORT_GATE
from ..functions.parse import clean_double, to_number
from ..functions.text import match_text, normalize_club, normalize_name
from ..session import c, cut_lineage, shuffled
from .fuzzy import fuzzy_best, token_sort_ratio


def last_wins(df: DataFrame, keys, values, order) -> DataFrame:
    """One row per key: that with the greatest ``order``, NULL values included."""
    picked = F.max_by(F.struct(*[c(v) for v in values]), F.struct(*[c(o) for o in order]))
    return df.groupBy(*[c(k) for k in keys]).agg(picked.alias("_v")).select(
        *[c(k) for k in keys], *[F.col("_v").getField(v).alias(v) for v in values]
    )


def value_lookup(
    values: DataFrame, name="player_name_tm", club="club_tm", value="market_value_eur",
    order=("season", "league_tm", "club_tm", "player_name_tm"),
) -> DataFrame:
    """(norm, value, club_norm), one row per normalised name; the last loaded row wins."""
    order = [o for o in order if o in values.columns]
    keyed = values.withColumn("norm", normalize_name(c(name)))
    keyed = keyed.withColumn(
        "club_norm", normalize_club(c(club)) if club in values.columns else F.lit("")
    )
    return last_wins(keyed, ["norm"], [value, "club_norm"], order)


def exact_values(df: DataFrame, lookup: DataFrame, player="Player", value="market_value_eur") -> DataFrame:
    """First pass on its own: equality of normalised names, league ignored."""
    keyed = df.drop(value).withColumn("norm", normalize_name(c(player)))
    return keyed.join(shuffled(lookup.select("norm", c(value))), "norm", "left").drop("norm")


def match_market_values(
    df: DataFrame, values: DataFrame, player="Player", squad="Squad", value="market_value_eur",
    threshold: float = FUZZY_THRESHOLD, club_threshold: float = FUZZY_THRESHOLD_CLUB, **lookup_columns,
) -> DataFrame:
    """Three passes: equal names; best fuzzy name at 80; best at 70 if the clubs agree.

    In the third pass only the single best candidate may be accepted. It is
    looked for only where some candidate of the same club reaches the threshold:
    without one the best candidate cannot be of that club either.
    """
    lookup = cut_lineage(value_lookup(values, value=value, **lookup_columns))
    df = df.drop(value).withColumn("_norm", normalize_name(c(player)))
    has_club = squad in df.columns
    df = df.withColumn("_club", normalize_club(c(squad)) if has_club else F.lit(""))

    known = lookup.where(c(value).isNotNull()).select(F.col("norm").alias("_norm"), c(value))
    open_names = cut_lineage(
        df.select("_norm", "_club").distinct().join(shuffled(known), "_norm", "left_anti")
    )
    second = fuzzy_best(open_names, lookup, threshold, left_norm="_norm")
    second = cut_lineage(
        second.join(shuffled(lookup), second.norm_r == lookup.norm)
        .where(c(value).isNotNull())
        .select(F.col("norm_l").alias("_norm"), c(value))
    )
    out = df.join(shuffled(known.unionByName(second)), "_norm", "left")
    if not has_club:
        return out.drop("_norm", "_club")

    rest = open_names.where(F.col("_club") != "").join(shuffled(second), "_norm", "left_anti")
    rest = rest.select("_norm", F.col("_club").alias("club_norm"))
    same_club = fuzzy_best(
        rest, lookup.where(F.col("club_norm") != ""), club_threshold, ["club_norm"], left_norm="_norm"
    )
    # its same-club score is one that the best candidate reaches, so nothing below is searched
    best = fuzzy_best(same_club.select(F.col("norm_l").alias("norm"), "score"), lookup, club_threshold, known="score")
    third = (
        best.join(shuffled(lookup), best.norm_r == lookup.norm)
        .where(F.col("club_norm") != "")
        .select(
            F.col("norm_l").alias("_norm"),
            F.col("club_norm").alias("_club"),
            c(value).alias("_third"),
        )
    )
    third = third.join(shuffled(second), "_norm", "left_anti")
    return (
        out.join(shuffled(third), ["_norm", "_club"], "left")
        .withColumn(value, F.coalesce(c(value), F.col("_third")))
        .drop("_norm", "_club", "_third")
    )


def xg_rollup(xg: DataFrame, league="League", player="Player", stats=("xG", "xA")) -> DataFrame:
    """Sums per raw player name over the seasons, unparsable values as 0."""
    kinds = dict(xg.dtypes)

    def num(s: str):
        v = to_number(c(s)) if kinds[s] == "string" else clean_double(c(s))
        return F.coalesce(v, F.lit(0.0))

    return xg.groupBy(c(league), c(player)).agg(*[F.sum(num(s)).alias(s) for s in stats])


def xg_lookup(xg: DataFrame, league="League", player="Player", stats=("xG", "xA")) -> DataFrame:
    """(league, norm, xG, xA); names that normalise alike go to the last alphabetically."""
    keyed = xg_rollup(xg, league, player, stats).withColumn("norm", normalize_name(c(player)))
    return last_wins(keyed, [league, "norm"], list(stats), [player])


def attach_xg(
    df: DataFrame, xg: DataFrame | None, league="League", player="Player", stats=("xG", "xA"),
    threshold: float = FUZZY_THRESHOLD, gate: float = TOKEN_SORT_GATE, fuzzy: bool = True,
) -> DataFrame:
    """xG and xA within the league: equal names, then the best fuzzy one.

    The best candidate must also pass the token-sort gate, which turns away
    names that merely contain the other. Unmatched players keep NULLs. Values
    that were there before are overwritten.
    """
    df = df.drop(*stats)
    if xg is None:
        return df.withColumns({s: F.lit(None).cast("double") for s in stats})
    lookup = cut_lineage(xg_lookup(xg, league, player, stats))
    keyed = df.withColumn("_norm", normalize_name(c(player)))
    names = lookup.withColumnRenamed("norm", "_norm")
    if fuzzy:
        open_names = keyed.select(c(league), "_norm").distinct().join(
            shuffled(names), [league, "_norm"], "left_anti"
        )
        best = fuzzy_best(open_names, lookup, threshold, [league], left_norm="_norm")
        passed = token_sort_ratio(match_text(F.col("norm_l")), match_text(F.col("norm_r"))) >= gate
        near = (
            best.where(passed)
            .withColumnRenamed("norm_r", "norm")
            .join(shuffled(lookup), [league, "norm"])
            .select(c(league), F.col("norm_l").alias("_norm"), *[c(s) for s in stats])
        )
        names = names.unionByName(near)
    return keyed.join(shuffled(names), [league, "_norm"], "left").drop("_norm")


def observe_match_rate(df: DataFrame, leagues, league="League", stat="xG") -> tuple[DataFrame, Observation]:
    """``df``, and an observation that is filled by the first action on it: no second pass for the rate.

    ``leagues`` are the leagues to tell apart, a configured list.
    """
    hit = c(stat).isNotNull()
    seen = Observation("match rate")
    counts = []
    for i, x in enumerate(leagues):
        counts += [F.count_if(c(league) == x).alias(f"players_{i}"), F.count_if((c(league) == x) & hit).alias(f"matched_{i}")]
    return df.observe(seen, F.count(F.lit(1)).alias("players"), F.count_if(hit).alias("matched"), *counts), seen


def observed_match_rate(
    spark: SparkSession, seen: Observation, leagues, league="League", warn_below: float = MATCH_RATE_WARNING
) -> DataFrame:
    """The figures of ``match_rate`` from a filled observation; leagues without players are left out."""
    got = seen.get
    rows = [(x, got[f"players_{i}"], got[f"matched_{i}"]) for i, x in enumerate(leagues) if got[f"players_{i}"]]
    out = spark.createDataFrame(rows, f"`{league}` string, players long, matched long")
    return out.withColumn("rate", F.col("matched") / F.col("players")).withColumn("low", F.col("rate") < warn_below)


def match_rate(df: DataFrame, league="League", stat="xG", warn_below: float = MATCH_RATE_WARNING) -> DataFrame:
    """Share of matched players per league, and whether it is low."""
    hit = c(stat).isNotNull()
    return (
        df.groupBy(c(league))
        .agg(F.count(F.lit(1)).alias("players"), F.count_if(hit).alias("matched"))
        .withColumn("rate", F.col("matched") / F.col("players"))
        .withColumn("low", F.col("rate") < warn_below)
    )
