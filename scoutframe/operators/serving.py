"""Shortlists, searches, profiles and comparisons over the scored master table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGE_RANGE, PILLARS, POSITIONS, VALUE_RANGE_M, pillars_of
from ..functions.parse import parse_age
from ..functions.rates import traffic_band
from ..functions.text import stat_label
from ..session import c, small_side
from .ranking import exact_median, peer_percentile, with_rank


@dataclass
class ShortlistQuery:
    """Filters of one shortlist; an empty list does not filter."""

    leagues: list[str] = field(default_factory=list)
    positions: list[str] = field(default_factory=list)
    clubs: list[str] = field(default_factory=list)
    seasons: list[str] = field(default_factory=list)
    ages: tuple[float, float] = AGE_RANGE
    values_m: tuple[float, float] = VALUE_RANGE_M


def shortlist(df: DataFrame, q: ShortlistQuery) -> DataFrame:
    """All filters in one predicate, so they reach the scan together."""
    lo, hi = q.values_m
    keep = parse_age(c("Age")).between(*q.ages)
    keep = keep & c("market_value_eur").between(lo * 1_000_000, hi * 1_000_000)
    for column, wanted in (
        ("League", q.leagues), ("Pos", q.positions), ("Squad", q.clubs), ("_season", q.seasons),
    ):
        if wanted and column in df.columns:
            keep = keep & c(column).isin(*wanted)
    return df.where(keep)


DISPLAY = (
    "Player", "Squad", "League", "Pos", "Age", "scout_score", "uv_score",
    "uv_score_age_weighted", "market_value_eur", "value_gap_eur",
)


def display(df: DataFrame, ordered: bool = True, limit: int | None = None) -> DataFrame:
    """The ten shown columns, money in millions, whole years, best first."""
    special = {
        "Age": parse_age(c("Age")).cast("int"),
        "market_value_eur": c("market_value_eur") / 1_000_000,
        "value_gap_eur": c("value_gap_eur") / 1_000_000,
    }
    out = df.select(*[special.get(x, c(x)).alias(x) for x in DISPLAY if x in df.columns])
    if ordered:
        out = out.orderBy(F.desc("uv_score_age_weighted"), "League", "Player")
    return out.limit(limit) if limit is not None else out


def top_n(df: DataFrame, n: int = 5, by="uv_score", keys=("League", "Player")) -> DataFrame:
    return df.orderBy(F.desc(by), *[c(k) for k in keys]).limit(n)


def name_search(df: DataFrame, text: str | None, player="Player", regex: bool = False) -> DataFrame:
    """Names containing ``text``, case ignored; blank text is no filter."""
    text = (text or "").strip()
    if not text:
        return df
    if regex:
        return df.where(F.coalesce(c(player).rlike("(?i)" + text), F.lit(False)))
    return df.where(F.lower(c(player)).contains(text.lower()))


def club_options(df: DataFrame, leagues: list[str]) -> DataFrame:
    return (
        df.where(c("League").isin(*leagues) & c("Squad").isNotNull())
        .select("Squad").distinct().orderBy("Squad")
    )


def value_bound(df: DataFrame, value="market_value_eur", floor: int = 200) -> DataFrame:
    """Upper end of the value range in millions: full tens, 200 at least."""
    top = F.ceil(F.max(c(value)) / 1e7) * 10
    return df.agg(F.greatest(top, F.lit(floor)).cast("long").alias("value_bound_m"))


def counts(df: DataFrame, value="market_value_eur") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c(value).isNotNull()).alias("with_value")
    )


def lookup_profile(df: DataFrame, player: str, club: str | None = None, keys=("League", "Squad")) -> DataFrame:
    """One row of the named player, of the named club if given."""
    hit = c("Player") == player
    if club:
        hit = hit & (c("Squad") == club)
    return df.where(hit).orderBy(*[c(k) for k in keys]).limit(1)


def is_visible(filtered: DataFrame, player: str) -> DataFrame:
    """Does any name in the filtered rows contain the profiled name, literally?"""
    return filtered.agg((F.count_if(c("Player").contains(player)) > 0).alias("visible"))


def profile_header(df: DataFrame) -> DataFrame:
    """Display fields with '—' for what is missing; a value of 0 counts as missing."""

    def text(name: str) -> Column:
        return F.coalesce(c(name), F.lit("—")) if name in df.columns else F.lit("—")

    age = F.coalesce(parse_age(c("Age")).cast("int").cast("string"), c("Age").cast("string"), F.lit("—"))
    value = F.when(c("market_value_eur") != 0, c("market_value_eur") / 1_000_000)
    return df.select(
        text("Player").alias("name"), age.alias("age"), text("Squad").alias("club"),
        text("League").alias("league"), text("Pos").alias("position"),
        text("Nation").alias("nation"), value.alias("market_value_m"),
    )


def _unit_score(pillar: str, pos: Column) -> Column:
    out = None
    for p in POSITIONS:
        weight = next(x.weight for x in pillars_of(p) if x.name == pillar)
        v = c(f"score_{pillar}") / F.lit(weight / 100.0)
        out = F.when(pos == p, v) if out is None else out.when(pos == p, v)
    return out


def _clip(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def radar(df: DataFrame, players: DataFrame | None = None, keys=("League", "Player"), pos="Pos") -> DataFrame:
    """Per player and pillar the 0-100 score and the median of the position's peers.

    ``players`` restricts the shown rows; the medians always cover all of ``df``.
    """

    def long(frame: DataFrame) -> DataFrame:
        entries = [
            F.struct(F.lit(n).alias("pillar"), _unit_score(n, c(pos)).alias("unit")) for n in PILLARS
        ]
        return frame.where(c(pos).isin(*POSITIONS)).select(
            *[c(k) for k in keys], c(pos), F.explode(F.array(*entries)).alias("e")
        ).select(*[c(k) for k in keys], c(pos), "e.*")

    medians = small_side(exact_median(long(df), "unit", [pos, "pillar"], "median"))
    return (
        long(df if players is None else players)
        .join(medians, [pos, "pillar"], "left")
        .select(
            *[c(k) for k in keys], c(pos), "pillar",
            _clip(F.coalesce("unit", F.lit(0.0))).alias("score"),
            _clip(F.coalesce("median", F.lit(0.0))).alias("peer_median"),
        )
    )


def _stat_struct(df: DataFrame, pillar, n: int, stat: str, m: int) -> Column:
    raw = stat[:-4] if stat.endswith("_p90") else None
    return F.struct(
        F.lit(PILLARS.index(pillar.name)).alias("pillar_ix"),
        F.lit(pillar.name).alias("pillar"),
        F.lit(pillar.label).alias("label"),
        F.lit(m).alias("stat_ix"),
        F.lit(stat).alias("stat"),
        c(stat).cast("double").alias("value"),
        (c(raw).cast("double") if raw in df.columns else F.lit(None).cast("double")).alias("raw"),
    )


def _position_stats(df: DataFrame, pos: str) -> Column:
    return F.array(
        *[
            _stat_struct(df, p, n, s, m)
            for n, p in enumerate(pillars_of(pos))
            for m, s in enumerate(dict.fromkeys(x for x, _ in p.stats))
            if s in df.columns
        ]
    )


def profile_stats(df: DataFrame, keys=("League", "Player"), pos="Pos") -> DataFrame:
    """Stat table of every player: raw count, value, percentile among the position, band.

    Values are taken as they stand in ``df``; after scoring with ``overwrite``
    that is the normalised one. NULL stats are left out.
    """
    entries = None
    for p in POSITIONS:
        e = _position_stats(df, p)
        entries = F.when(c(pos) == p, e) if entries is None else entries.when(c(pos) == p, e)
    long = (
        df.where(c(pos).isin(*POSITIONS))
        .select(*[c(k) for k in keys], c(pos), F.explode(entries).alias("e"))
        .select(*[c(k) for k in keys], c(pos), "e.*")
        .where(F.col("value").isNotNull())
    )
    ranked = with_rank(long, "value", "percentile", peer_percentile, [pos, "pillar", "stat"])
    return ranked.withColumn("display", stat_label(c("stat"))).withColumn(
        "band", traffic_band(c("percentile"))
    )


def percentile_of(values: DataFrame, peers: DataFrame, by, value="value") -> DataFrame:
    """Percentile of a few values in a large peer table, by counting the smaller ones.

    ``values`` is small (checked before it is broadcast); peers are only
    counted, partially on each task. Without peers the answer is 50.
    """
    by = list(by)
    few = small_side(values.withColumnRenamed(value, "_v").withColumn("_at", F.xxhash64(*by, "_v")))
    wanted = peers.where(c(value).isNotNull()).select(*[c(b) for b in by], c(value))
    counted = (
        wanted.join(few.select(*by, "_v", "_at").distinct(), by)
        .groupBy("_at")
        .agg(F.count_if(F.round(c(value), 9) < F.round("_v", 9)).alias("_below"), F.count(F.lit(1)).alias("_n"))
    )
    pct = peer_percentile(F.col("_below"), F.lit(1), F.col("_n"))
    return (
        few.join(counted, "_at", "left")
        .withColumn("percentile", F.when(c("_v").isNotNull(), F.coalesce(pct, F.lit(50.0))))
        .withColumnRenamed("_v", value)
        .drop("_at", "_below", "_n")
    )


def comparison(df: DataFrame, players: list[tuple[str, str]], pos="Pos") -> DataFrame:
    """Two or three players side by side on the first one's pillars.

    ``players`` are (league, name). Each value's percentile is that among the
    player's own position.
    """
    if not 2 <= len(players) <= 3:
        raise ValueError("a comparison takes two or three players")
    slot = F.coalesce(
        *[
            F.when((c("League") == lg) & (c("Player") == name), F.lit(i + 1))
            for i, (lg, name) in enumerate(players)
        ]
    )
    chosen = small_side(df.withColumn("slot", slot).where(F.col("slot").isNotNull()))
    first = chosen.where("slot = 1").select(pos).head()
    ref = first[0] if first and first[0] in POSITIONS else "MF"
    stats = _position_stats(df, ref)
    mine = chosen.select("slot", c(pos), F.explode(stats).alias("e")).select("slot", c(pos), "e.*")
    peers = (
        df.join(chosen.select(pos).distinct(), pos, "left_semi")
        .select(c(pos), F.explode(stats).alias("e"))
        .select(c(pos), "e.pillar", "e.stat", "e.value")
    )
    table = percentile_of(mine, peers, [pos, "pillar", "stat"])
    slots = list(range(1, len(players) + 1))
    wide = (
        table.groupBy("pillar_ix", "pillar", "label", "stat_ix", "stat")
        .pivot("slot", slots)
        .agg(F.first("value").alias("value"), F.first("percentile").alias("percentile"))
    )
    return wide.select(
        "pillar_ix", "pillar", "label", "stat_ix", "stat",
        *[c(f"{s}_{m}").alias(f"{m}_{s}") for s in slots for m in ("value", "percentile")],
    )


def scatter_points(df: DataFrame, highlighted=()) -> DataFrame:
    """Score against value in millions, non-positive values left out."""
    return df.where(c("scout_score").isNotNull() & (c("market_value_eur") > 0)).select(
        "Player", "Squad", "Pos", "scout_score",
        (c("market_value_eur") / 1_000_000).alias("market_value_m"), "uv_score",
        (c("Player").isin(*highlighted) if highlighted else F.lit(False)).alias("highlighted"),
    )
