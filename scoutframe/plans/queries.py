"""Registered queries: each runs an operator over whole tables, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PER90_STATS, PILLARS, SUM_STATS, pillars_of, POSITIONS
from ..functions import parse, rates, text
from ..operators import matching, merge, neighbours, ranking, regression, rollup, scoring, serving
from ..operators import standings as tables
from ..operators.fuzzy import fuzzy_best
from ..session import c, cut_lineage, scratch_path, small_side, spread
from ..sources import files, html, items
from . import bindings as b
from .oracles import (
    AGE, FACTOR, MULTIPLIER, NORMED, SAVE_RATE, club_sql, norm_sql, q, rounded, sorted_sql, edit_sql, sql,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def pick(df: DataFrame, *plain: str, r6=()) -> DataFrame:
    """Named columns; the ``r6`` ones rounded to six places."""
    return df.select(*[c(x) for x in plain], *[F.round(c(x), 6).alias(x) for x in r6])


def p90(*stats: str) -> list[str]:
    return [f"{s}_p90" for s in stats]


# --- roll-up, rates, filters -----------------------------------------------------

_SUMS = [s for s in SUM_STATS if s not in ("xG", "xA")]


@query("season_rollup", sql(f"""
SELECT "League", "Player", {', '.join(q(s) for s in _SUMS)}, {rounded(["xG", "xA"], 8)}, "Squad", "Pos", "Age",
  single_season, last_season FROM ru""", "ru"))
def season_rollup(spark, sf):
    d = pick(b.rolled(spark, sf), "League", "Player", *_SUMS, "Squad", "Pos", "Age",
             "single_season", "last_season", "xG", "xA")
    return d.withColumns({x: F.round(x, 8) for x in ("xG", "xA")})


@query("rollup_last_nonnull", sql("""
SELECT "League", "Player",
  arg_max("Squad", season) FILTER ("Gls" >= 2) AS "Squad", arg_max("Pos", season) FILTER ("Ast" >= 2) AS "Pos"
FROM cs GROUP BY 1, 2""", "cs"))
def rollup_last_nonnull(spark, sf):
    s = b.cust_season(spark, sf).withColumns({
        "Squad": F.when(c("Gls") >= 2, c("Squad")), "Pos": F.when(c("Ast") >= 2, c("Pos")),
    })
    return rollup.season_rollup(s, stats=(), last=("Squad", "Pos")).select("League", "Player", "Squad", "Pos")


@query("per90", sql(f"""
SELECT "League", "Player", {', '.join(f'round({q(s)} / nullif("Min", 0) * 90, 6) AS {q(s + "_p90")}' for s in PER90_STATS)}
FROM ru""", "ru"))
def per90(spark, sf):
    return pick(rollup.add_per90(b.rolled(spark, sf)), "League", "Player", r6=p90(*PER90_STATS))


@query("save_rate", sql(f'SELECT "League", "Player", round({SAVE_RATE}, 6) AS "Save%" FROM ru', "ru"))
def save_rate(spark, sf):
    return pick(rollup.derive_rates(b.rolled(spark, sf)), "League", "Player", r6=["Save%"])


@query("ratio_zero_safe", sql("""
SELECT "League", "Player", season, round("Gls" / nullif("Ast", 0) * 100, 6) AS gls_per_ast,
  round("SoT" / nullif("Gls" + "Ast", 0), 6) AS sot_per_goal FROM cs""", "cs"))
def ratio_zero_safe(spark, sf):
    return b.cust_season(spark, sf).select(
        "League", "Player", "season",
        F.round(rates.ratio(c("Gls"), c("Ast"), 100.0), 6).alias("gls_per_ast"),
        F.round(rates.ratio(c("SoT"), c("Gls") + c("Ast")), 6).alias("sot_per_goal"),
    )


@query("minutes_filter", sql(f"""
SELECT ru."League", "Player", "Min" FROM ru
JOIN (SELECT "League", count(DISTINCT season) AS n FROM cs GROUP BY 1) s ON s."League" = ru."League"
WHERE coalesce("Min", 0) >= {b.PER_SEASON} * n""", "ru"))
def minutes_filter(spark, sf):
    players = cut_lineage(b.rolled(spark, sf))
    span = small_side(rollup.league_span(players))
    return rollup.career_minutes(players, span, per_season=b.PER_SEASON).select("League", "Player", "Min")


@query("table_minutes_filter", sql('SELECT "League", "Player", season, "Min" FROM cs WHERE "Min" >= 100', "cs"))
def table_minutes_filter(spark, sf):
    s = rollup.named_players(b.cust_season(spark, sf))
    return rollup.min_minutes(s, threshold=100).select("League", "Player", "season", "Min")


@query("active_latest_semi", sql("""
SELECT "League", "Player", single_season FROM ru WHERE EXISTS (
  SELECT 1 FROM cs WHERE cs."League" = ru."League" AND cs."Player" = ru."Player"
  AND cs.season = (SELECT max(season) FROM cs c2 WHERE c2."League" = ru."League"))""", "ru"))
def active_latest_semi(spark, sf):
    s = cut_lineage(b.cust_season(spark, sf))
    return rollup.active_in_latest(rollup.season_rollup(s), s).select("League", "Player", "single_season")


@query("players_rated", sql(f"""
SELECT "League", "Player", "Squad", "Pos", "Age", {rounded(["Save%", *p90(*PER90_STATS)])} FROM pl""", "pl"))
def players_rated(spark, sf):
    return pick(b.rated(spark, sf), "League", "Player", "Squad", "Pos", "Age", r6=["Save%", *p90(*PER90_STATS)])


# --- joins and dedup -------------------------------------------------------------

def nine_tables(spark, sf) -> dict[str, DataFrame]:
    """The season view cut into nine tables with overlapping columns and NULL keys."""
    s = cut_lineage(b.cust_season(spark, sf).withColumn("Age", F.when(c("market_value_eur") > 0, c("Age"))))
    keys = ["League", "season", "Player", "Squad", "Pos", "Age"]

    def t(where=None, **cols):
        d = s if where is None else s.where(where)
        return d.select(*keys, *[e.alias(n) for n, e in cols.items()])

    k = {x: c(x) for x in ("Min", "Gls", "Ast", "Sh", "SoT", "Int", "TklW", "Fls", "Fld", "Crs", "Saves", "GA", "xG")}
    zero = F.lit(-1.0)
    return {
        "stats_standard": t(Min=k["Min"], Gls=k["Gls"], Ast=k["Ast"], PrgC=zero, PrgP=zero),
        "stats_shooting": t(c("Sh") >= 3, Sh=k["Sh"], SoT=k["SoT"], Gls=zero, xG=k["xG"]),
        "stats_passing": t(c("Ast") >= 1, PrgP=k["Crs"], Att=k["Fld"], xAG=zero, Ast=zero),
        "stats_defense": t(c("Int") >= 1, Int=k["Int"], TklW=k["TklW"], Succ=zero),
        "stats_possession": t(c("Gls") >= 1, PrgC=k["Fls"], Att=k["SoT"]),
        "stats_misc": t(Fls=k["Fls"], Fld=k["Fld"], Crs=k["Crs"], Won=k["Gls"], Lost=k["GA"]),
        "stats_gca": t(c("Crs") >= 1, SCA=k["Crs"], GCA=zero),
        "stats_keeper": t(c("Pos") == "GK", Saves=k["Saves"], GA=k["GA"], Min=zero),
        "stats_keeper_adv": t(c("Pos") == "GK", GA=zero, PSxG=k["xG"]),
    }


@query("star_join_nine", sql("""
SELECT "League", season, "Player", "Squad", "Pos", CASE WHEN market_value_eur > 0 THEN "Age" END AS "Age", "Min", "Gls", "Ast",
  CASE WHEN "Sh" >= 3 THEN "Sh" END AS "Sh", CASE WHEN "Sh" >= 3 THEN "SoT" END AS "SoT",
  CASE WHEN "Ast" >= 1 THEN "Crs" END AS "PrgP", CASE WHEN "Ast" >= 1 THEN "Fld" END AS "Att",
  CASE WHEN "Int" >= 1 THEN "Int" END AS "Int", CASE WHEN "Int" >= 1 THEN "TklW" END AS "TklW",
  CASE WHEN "Gls" >= 1 THEN "Fls" END AS "PrgC", CASE WHEN "Gls" >= 1 THEN "SoT" END AS "Att_drb",
  "Fls", "Fld", "Crs", "Gls" AS "AerWon", "GA" AS "AerLost", CASE WHEN "Crs" >= 1 THEN "Crs" END AS "SCA",
  CASE WHEN "Pos" = 'GK' THEN "Saves" END AS "Saves", CASE WHEN "Pos" = 'GK' THEN "GA" END AS "GA",
  CASE WHEN "Pos" = 'GK' THEN "xG" END AS "PSxG"
FROM cs""", "cs"))
def star_join_nine(spark, sf):
    return merge.star_join(nine_tables(spark, sf), dedup=False)


@query("summary_row_dedup", sql("""
WITH o AS (SELECT c_name AS "Player", CAST(year(o_orderdate) AS VARCHAR) AS season, o_orderpriority AS "Squad", sum(o_totalprice) AS "Min"
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
s AS (SELECT "Player", season, count(*) || ' Clubs' AS "Squad", sum("Min") AS "Min" FROM o GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT "Player", season, "Squad", round("Min", 2) AS "Min" FROM s
UNION ALL
SELECT "Player", season, "Squad", round("Min", 2) FROM o
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s."Player" = o."Player" AND s.season = o.season)"""))
def summary_row_dedup(spark, sf):
    who = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("Player"))
    clubs = (
        b.table(spark, sf, "orders").join(who, "o_custkey")
        .groupBy("Player", F.year("o_orderdate").cast("string").alias("season"), F.col("o_orderpriority").alias("Squad"))
        .agg(F.sum("o_totalprice").alias("Min"))
    )
    totals = clubs.groupBy("Player", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("Min").alias("Min"))
    totals = totals.where("n >= 2").select(
        "Player", "season", F.concat(F.col("n").cast("string"), F.lit(" Clubs")).alias("Squad"), "Min"
    )
    out = merge.dedup_multiclub(clubs.unionByName(totals))
    return out.withColumn("Min", F.round("Min", 2))


@query("first_seen_dedup", """
SELECT p_name, p_partkey, p_brand, round(p_retailprice, 2) AS p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS rn FROM part) WHERE rn = 1""")
def first_seen_dedup(spark, sf):
    p = b.table(spark, sf, "part").select("p_name", "p_partkey", "p_brand", F.round("p_retailprice", 2).alias("p_retailprice"))
    return merge.first_seen(p, ["p_name"], ["p_brand", "p_partkey"])


@query("union_seasons", sql("""
SELECT player_name_tm, club_tm, round(market_value_eur, 4) AS market_value_eur, season, league_tm
FROM (SELECT player_name_tm, club_tm, CASE WHEN market_value_eur >= 1000000 THEN market_value_eur END AS market_value_eur, season, league_tm FROM nv
  UNION ALL SELECT s_name, NULL, s_acctbal, '2022-23', NULL FROM supplier)
WHERE season IN ('2023-24', '2024-25') AND market_value_eur IS NOT NULL""", "nv"))
def union_seasons(spark, sf):
    v = b.name_values(spark, sf)
    v = v.withColumn("market_value_eur", F.when(c("market_value_eur") >= 1_000_000, c("market_value_eur")))
    old = b.table(spark, sf, "supplier").select(
        F.col("s_name").alias("player_name_tm"), F.col("s_acctbal").alias("market_value_eur"), F.lit("2022-23").alias("season")
    )
    both = files.value_table(merge.union_aligned([v, old]))
    return both.withColumn("market_value_eur", F.round("market_value_eur", 4))


# --- standings -------------------------------------------------------------------

_TABLE = ["League", "season", "Squad", "W", "D", "L", "GF", "GA", "Pts", "GD", "Rk"]


@query("league_table", sql("SELECT " + ", ".join(f"CAST({q(x)} AS BIGINT) AS {q(x)}" if x not in ("League", "season", "Squad") else q(x) for x in _TABLE) + " FROM st", "st"))
def league_table(spark, sf):
    t = b.standings(spark, sf)
    return t.select("League", "season", "Squad", *[c(x).cast("long").alias(x) for x in _TABLE[3:]])


_NATION_NAMES = {"NATION_1": "One United", "NATION_2": "Köln", "NATION_3": "NATION_3"}


@query("team_name_map", """
SELECT s_suppkey, CASE n_name WHEN 'NATION_1' THEN 'One United' WHEN 'NATION_2' THEN 'Köln' ELSE n_name END AS team
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def team_name_map(spark, sf):
    n = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team"))
    s = b.table(spark, sf, "supplier").join(n, "s_nationkey").select("s_suppkey", "team")
    return tables.map_team(s, "team", _NATION_NAMES)


@query("standings_attach", sql('SELECT "League", "Player", "Squad", league_position FROM plr', "plr"))
def standings_attach(spark, sf):
    return b.with_rank_column(spark, sf).select("League", "Player", "Squad", "league_position")


# --- scoring ---------------------------------------------------------------------

@query("team_strength", sql(f'SELECT "League", "Player", "Pos", league_position, {rounded(["Int_p90", "Save%", "TklW_p90"])} FROM adj', "adj"))
def team_strength(spark, sf):
    return pick(b.strength_adjusted(spark, sf), "League", "Player", "Pos", "league_position", r6=["Int_p90", "Save%", "TklW_p90"])


_NORM_COLS = [f"{s}_norm" for s in NORMED]
_SCORES = [f"score_{p}" for p in PILLARS]


@query("minmax_norm", sql(f'SELECT "League", "Player", "Pos", {rounded(_NORM_COLS)} FROM nrm', "nrm"))
def minmax_norm(spark, sf):
    return pick(scoring.minmax(b.strength_adjusted(spark, sf)), "League", "Player", "Pos", r6=_NORM_COLS)


@query("pillar_scores", sql(f'SELECT "League", "Player", "Pos", {rounded(_SCORES)} FROM sco', "sco"))
def pillar_scores(spark, sf):
    return pick(b.scored(spark, sf), "League", "Player", "Pos", r6=_SCORES)


@query("scout_score", sql(f'SELECT "League", "Player", {rounded(["scout_score"])} FROM sco', "sco"))
def scout_score(spark, sf):
    return pick(b.scored(spark, sf), "League", "Player", r6=["scout_score"])


@query("ols_position", sql("""
SELECT "Pos", round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round((SELECT sum(sxy) / sum(sxx) FROM mom), 6) AS slope FROM mom""", "mom"))
def ols_position(spark, sf):
    pool = regression.positive_value(b.scored(spark, sf))
    return pick(regression.fit_by_position(pool), "Pos", r6=["mean_x", "mean_y", "slope"])


@query("uv_score", sql(f'SELECT "League", "Player", {rounded(["predicted_log_mv", "residual", "uv_score"])} FROM uv', "uv"))
def uv_score(spark, sf):
    return pick(b.valued(spark, sf), "League", "Player", r6=["predicted_log_mv", "residual", "uv_score"])


@query("value_gap", sql('SELECT "League", "Player", round(predicted_mv_eur, 2) AS predicted_mv_eur, round(value_gap_eur, 2) AS value_gap_eur FROM uv', "uv"))
def value_gap(spark, sf):
    return b.valued(spark, sf).select(
        "League", "Player", F.round("predicted_mv_eur", 2).alias("predicted_mv_eur"), F.round("value_gap_eur", 2).alias("value_gap_eur")
    )


@query("age_weighted", sql(f"""
SELECT "League", "Player", {AGE} AS age_years, round({MULTIPLIER}, 6) AS multiplier, round(uv_score * ({MULTIPLIER}), 6) AS uv_score_age_weighted FROM uv""", "uv"))
def age_weighted(spark, sf):
    d = scoring.age_weighted(b.valued(spark, sf))
    return d.select("League", "Player", parse.parse_age(c("Age")).alias("age_years"),
                    F.round(rates.age_multiplier(c("Age")), 6).alias("multiplier"),
                    F.round("uv_score_age_weighted", 6).alias("uv_score_age_weighted"))


@query("league_quality", sql(f'SELECT "League", "Player", league_quality_multiplier, {rounded(["uv_score_age_weighted"])} FROM mst', "mst"))
def league_quality(spark, sf):
    return pick(b.master(spark, sf), "League", "Player", "league_quality_multiplier", r6=["uv_score_age_weighted"])


@query("fair_value_line", sql("""
SELECT i::INT AS i, round(i * 100.0::DOUBLE / 199, 6) AS score, round(pow(10, b0 + b1 * (i * 100.0::DOUBLE / 199)), 6) AS fair_value_m
FROM (SELECT regr_slope(log10(market_value_eur / 1000000), scout_score) AS b1, regr_intercept(log10(market_value_eur / 1000000), scout_score) AS b0
  FROM mst WHERE "Pos" IN ('FW', 'MF') AND market_value_eur > 0), range(200) t(i)""", "mst"))
def fair_value_line(spark, sf):
    pool = serving.shortlist(b.master(spark, sf), serving.ShortlistQuery(positions=["FW", "MF"], ages=(0, 100)))
    return pick(regression.fair_value_line(pool), "i", r6=["score", "fair_value_m"])


# --- neighbours ------------------------------------------------------------------

def similar_master(spark, sf):
    return neighbours.similar_players(b.master(spark, sf))


@query("similar_top5", sql("""
SELECT lg AS "League", player AS "Player", rank::INT AS rank, player2 AS neighbour, league2 AS neighbour_league, club2 AS neighbour_club, round(uv2, 6) AS neighbour_uv FROM sim""", "sim"))
def similar_top5(spark, sf):
    s = similar_master(spark, sf).select("League", "Player", F.posexplode("similar").alias("at", "s"))
    return s.select("League", "Player", (F.col("at") + 1).alias("rank"), F.col("s.player").alias("neighbour"),
                    F.col("s.league").alias("neighbour_league"), F.col("s.club").alias("neighbour_club"),
                    F.round("s.uv_score_age_weighted", 6).alias("neighbour_uv"))


@query("similar_enriched", sql(f"""
SELECT lg AS "League", sim.player AS "Player", rank::INT AS rank, player2 AS neighbour,
  CAST(floor({AGE}) AS INT) AS age, round(market_value_eur / 1000000, 6) AS market_value_m
FROM sim JOIN mst ON mst."Player" = player2 AND mst."Squad" = club2""", "sim"))
def similar_enriched(spark, sf):
    e = neighbours.enrich_similar(cut_lineage(similar_master(spark, sf)))
    return e.select(F.col("of_League").alias("League"), F.col("of_Player").alias("Player"), "rank",
                    F.col("player").alias("neighbour"), "age", F.round("market_value_m", 6).alias("market_value_m"))


# --- serving ---------------------------------------------------------------------

_SHORT = serving.ShortlistQuery(leagues=["EUROPE", "ASIA", "AFRICA"], positions=["FW", "MF", "GK"], ages=(18, 33), values_m=(1, 60))
_SHORT_SQL = f""""League" IN ('EUROPE', 'ASIA', 'AFRICA') AND "Pos" IN ('FW', 'MF', 'GK') AND {AGE} BETWEEN 18 AND 33
  AND market_value_eur BETWEEN 1000000 AND 60000000"""
_MONEY = 'round(market_value_eur / 1000000, 6) AS market_value_eur, round(value_gap_eur / 1000000, 6) AS value_gap_eur'
_DISPLAY_SQL = f""""Player", "Squad", "League", "Pos", CAST(floor({AGE}) AS INT) AS "Age",
  {rounded(["scout_score", "uv_score", "uv_score_age_weighted"])}, {_MONEY}"""
_DISPLAY_R = ["scout_score", "uv_score", "uv_score_age_weighted", "market_value_eur", "value_gap_eur"]


@query("shortlist_filtered", sql(f"SELECT {_DISPLAY_SQL} FROM mst WHERE {_SHORT_SQL}", "mst"))
def shortlist_filtered(spark, sf):
    d = serving.display(serving.shortlist(b.master(spark, sf), _SHORT), ordered=False)
    return pick(d, "Player", "Squad", "League", "Pos", "Age", r6=_DISPLAY_R)


@query("shortlist_top25", sql(f"""
SELECT {_DISPLAY_SQL} FROM mst WHERE {_SHORT_SQL} ORDER BY mst.uv_score_age_weighted DESC, "League", "Player" LIMIT 25""", "mst"))
def shortlist_top25(spark, sf):
    d = serving.display(serving.shortlist(b.master(spark, sf), _SHORT), limit=25)
    return pick(d, "Player", "Squad", "League", "Pos", "Age", r6=_DISPLAY_R)


_CLUBS, _YEARS = [f"NATION_{i}" for i in range(0, 25, 3)], ["1995", "1996", "1998"]


@query("shortlist_clubs_seasons", sql(f"""
SELECT "League", "Player", "Squad", season, "Min", "Gls" FROM cs
WHERE "Squad" IN ({', '.join(f"'{x}'" for x in _CLUBS)}) AND season IN ({', '.join(f"'{x}'" for x in _YEARS)})
  AND {AGE} BETWEEN 20 AND 30 AND market_value_eur BETWEEN 0 AND 80000000""", "cs"))
def shortlist_clubs_seasons(spark, sf):
    """The club and season filters, on rows of single seasons."""
    wanted = serving.ShortlistQuery(clubs=_CLUBS, seasons=_YEARS, ages=(20, 30), values_m=(0, 80))
    d = serving.shortlist(b.cust_season(spark, sf).withColumnRenamed("season", "_season"), wanted)
    return d.select("League", "Player", "Squad", c("_season").alias("season"), "Min", "Gls")


@query("top_undervalued", sql('SELECT "League", "Player", round(uv_score, 6) AS uv_score FROM uv ORDER BY uv.uv_score DESC, "League", "Player" LIMIT 5', "uv"))
def top_undervalued(spark, sf):
    return pick(serving.top_n(b.valued(spark, sf)), "League", "Player", r6=["uv_score"])


@query("name_search", sql('SELECT "League", "Player" FROM pl WHERE lower("Player") LIKE \'%r#000000%9%\' AND contains(lower("Player"), \'r#0000000\')', "pl"))
def name_search(spark, sf):
    d = serving.name_search(b.rated(spark, sf), " R#0000000 ")
    return serving.name_search(d, "r#000000.*9", regex=True).select("League", "Player")


@query("club_options", sql("SELECT DISTINCT \"Squad\" FROM pl WHERE \"League\" IN ('ASIA', 'EUROPE')", "pl"))
def club_options(spark, sf):
    return serving.club_options(b.rated(spark, sf), ["ASIA", "EUROPE"])


@query("value_bound", sql("""
SELECT CAST(greatest(ceil(max(market_value_eur) / 1e7::DOUBLE) * 10, 200) AS BIGINT) AS value_bound_m,
  count(*) AS "rows", count(market_value_eur) AS with_value FROM pl""", "pl"))
def value_bound(spark, sf):
    d = cut_lineage(b.rated(spark, sf).select("market_value_eur"))
    one = F.lit(1).alias("_k")
    return serving.value_bound(d).withColumn("_k", one).join(serving.counts(d).withColumn("_k", one), "_k").drop("_k")


_NAMED = "Customer#000000012"


@query("lookup_profile", sql(f"""
SELECT "Player" AS name, CAST(CAST(floor({AGE}) AS INT) AS VARCHAR) AS age, "Squad" AS club, "League" AS league, "Pos" AS position, '—' AS nation,
  round(CASE WHEN market_value_eur <> 0 THEN market_value_eur / 1000000 END, 6) AS market_value_m FROM ru WHERE "Player" = '{_NAMED}'""", "ru"))
def lookup_profile(spark, sf):
    h = serving.profile_header(serving.lookup_profile(b.rolled(spark, sf), _NAMED))
    return h.withColumn("market_value_m", F.round("market_value_m", 6))


@query("profile_visible", sql(f"""
SELECT count_if(contains("Player", '{_NAMED}')) > 0 AS visible FROM ru WHERE "Pos" IN ('FW', 'GK')""", "ru"))
def profile_visible(spark, sf):
    return serving.is_visible(b.rolled(spark, sf).where(c("Pos").isin("FW", "GK")), _NAMED)


# --- profiles --------------------------------------------------------------------

def _stats_union() -> str:
    """One SELECT per (position, pillar, stat) over the normalised columns."""
    out = []
    for pos in POSITIONS:
        for p in pillars_of(pos):
            for s, _ in p.stats:
                raw = q(s[:-4]) if s.endswith("_p90") else "NULL::DOUBLE"
                out.append(
                    f"""SELECT "League", "Player", "Pos", '{p.name}' AS pillar, '{p.label}' AS label, '{s}' AS stat,
 '{s.replace('_p90', '/90').replace('_', ' ')}' AS display, {raw} AS raw, {q(s + '_norm')} AS value FROM sco WHERE "Pos" = '{pos}'"""
                )
    return " UNION ALL ".join(out)


_PCT = """(rank() OVER (PARTITION BY "Pos", pillar, stat ORDER BY round(value, 9))) / (count(*) OVER (PARTITION BY "Pos", pillar, stat) + 1)::DOUBLE * 100"""


@query("profile_percentiles", sql(f"""
SELECT "League", "Player", "Pos", pillar, label, stat, display, round(raw, 8) AS raw, round(value, 6) AS value, round(pct, 6) AS percentile,
  CASE WHEN pct < 33 THEN 'red' WHEN pct < 66 THEN 'amber' ELSE 'green' END AS band
FROM (SELECT *, {_PCT} AS pct FROM ({_stats_union()}))""", "sco"))
def profile_percentiles(spark, sf):
    d = serving.profile_stats(b.scored(spark, sf))
    return pick(d, "League", "Player", "Pos", "pillar", "label", "stat", "display", "band", "raw", r6=["value", "percentile"]).withColumn("raw", F.round("raw", 8))


def _radar_sql() -> str:
    parts = []
    for name in PILLARS:
        w = " ".join(f"WHEN '{p}' THEN {next(x.weight for x in pillars_of(p) if x.name == name) / 100.0}::DOUBLE" for p in POSITIONS)
        parts.append(f"""SELECT "League", "Player", "Pos", '{name}' AS pillar, score_{name} / CASE "Pos" {w} END AS unit FROM sco""")
    return " UNION ALL ".join(parts)


@query("radar", sql(f"""
SELECT "League", "Player", "Pos", pillar, round(least(100, greatest(0, unit)), 6) AS score,
  round(least(100, greatest(0, med)), 6) AS peer_median
FROM (SELECT *, median(round(unit, 9)) OVER (PARTITION BY "Pos", pillar) AS med FROM ({_radar_sql()}))""", "sco"))
def radar(spark, sf):
    d = serving.radar(b.scored(spark, sf))
    return pick(d, "League", "Player", "Pos", "pillar", r6=["score", "peer_median"])


def _compared(spark, sf):
    """The best scored forward, midfielder and defender of the whole pool."""
    d = cut_lineage(b.scored(spark, sf))
    who = []
    for pos in ("FW", "MF", "DF"):
        r = d.where(c("Pos") == pos).orderBy(F.desc("scout_score"), "League", "Player").select("League", "Player").head()
        who.append((r["League"], r["Player"]))
    return d, who


_CMP_STATS = ", ".join(
    f"({i}, '{p.name}', '{p.label}', {j}, '{s}')" for i, p in enumerate(pillars_of("FW")) for j, (s, _) in enumerate(p.stats)
)
_CMP_VALUE = "CASE stat " + " ".join(
    f"WHEN '{s}' THEN coalesce({q(s + '_norm')}, {q(s)})" for s in dict.fromkeys(x for p in pillars_of("FW") for x, _ in p.stats)
) + " END"


@query("comparison_pivot", sql(f"""
SELECT pillar_ix, pillar, label, stat_ix, stat, {', '.join(
    f'round(max(CASE WHEN slot = {n} THEN value END), 6) AS value_{n}, round(max(CASE WHEN slot = {n} THEN pct END), 6) AS percentile_{n}' for n in (1, 2, 3))}
FROM (
  SELECT *, rank() OVER (PARTITION BY "Pos", pillar, stat ORDER BY round(value, 9)) / (count(*) OVER (PARTITION BY "Pos", pillar, stat) + 1)::DOUBLE * 100 AS pct
  FROM (SELECT "Pos", slot, pillar_ix, pillar, label, stat_ix, stat, {_CMP_VALUE} AS value
    FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY "Pos" ORDER BY scout_score DESC, "League", "Player") = 1
        THEN CASE "Pos" WHEN 'FW' THEN 1 WHEN 'MF' THEN 2 ELSE 3 END END AS slot FROM sco WHERE "Pos" IN ('FW', 'MF', 'DF'))
    CROSS JOIN (VALUES {_CMP_STATS}) v(pillar_ix, pillar, label, stat_ix, stat)))
WHERE slot IS NOT NULL GROUP BY ALL""", "sco"))
def comparison_pivot(spark, sf):
    d = serving.comparison(*_compared(spark, sf))
    cols = [f"{m}_{n}" for n in (1, 2, 3) for m in ("value", "percentile")]
    return pick(d, "pillar_ix", "pillar", "label", "stat_ix", "stat", r6=cols)


@query("scatter_points", sql(f"""
SELECT "Player", "Squad", "Pos", {rounded(["scout_score", "uv_score"])}, round(market_value_eur / 1000000, 6) AS market_value_m,
  "Player" = '{_NAMED}' AS highlighted FROM uv""", "uv"))
def scatter_points(spark, sf):
    d = serving.scatter_points(b.valued(spark, sf), [_NAMED])
    return pick(d, "Player", "Squad", "Pos", "highlighted", r6=["scout_score", "uv_score", "market_value_m"])


# --- names and matching ----------------------------------------------------------

@query("name_normalize", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def name_normalize(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.normalize_name(c("text")).alias("norm"))


_CLUB = "concat('FC ', text, ' afc Cf.')"


@query("club_normalize", f"SELECT doc_id, {club_sql(_CLUB)} AS norm FROM documents")
def club_normalize(spark, sf):
    club = F.concat(F.lit("FC "), c("text"), F.lit(" afc Cf."))
    return b.table(spark, sf, "documents").select("doc_id", text.normalize_club(club).alias("norm"))


@query("exact_match_last_wins", sql(f"""
SELECT id, "Player", round(market_value_eur, 4) AS market_value_eur FROM mp LEFT JOIN lk ON lk.norm = {norm_sql(q('Player'))}""", "mp", "lk"))
def exact_match_last_wins(spark, sf):
    d = matching.exact_values(b.misspelt_players(spark, sf), matching.value_lookup(b.name_values(spark, sf)))
    return d.select("id", "Player", F.round("market_value_eur", 4).alias("market_value_eur"))


@query("fuzzy_match", sql("SELECT norm_l, norm_r, score FROM fz WHERE score >= 80", "fz"))
def fuzzy_match(spark, sf):
    left = b.misspelt_players(spark, sf).select(text.normalize_name(c("Player")).alias("norm"))
    return fuzzy_best(left, matching.value_lookup(b.name_values(spark, sf)), 80)


@query("fuzzy_club_gate", sql(f"""
SELECT id, "Player", "Squad", round(coalesce(e.market_value_eur, f.market_value_eur), 4) AS market_value_eur
FROM (SELECT *, {norm_sql(q('Player'))} AS n FROM mp) m LEFT JOIN lk e ON e.norm = m.n
LEFT JOIN (SELECT fz.norm_l, fz.score, lk.* FROM fz JOIN lk ON lk.norm = fz.norm_r) f
  ON f.norm_l = m.n AND (f.score >= 80 OR (f.cn <> '' AND f.cn = {club_sql(q('Squad'))}))""", "mp", "fz"))
def fuzzy_club_gate(spark, sf):
    d = matching.match_market_values(b.misspelt_players(spark, sf), b.name_values(spark, sf))
    return d.select("id", "Player", "Squad", F.round("market_value_eur", 4).alias("market_value_eur"))


_XG_JOIN = f"""FROM (SELECT *, {norm_sql(q('Player'))} AS n FROM mp) m
LEFT JOIN xl e ON e."League" = m."League" AND e.norm = m.n"""


@query("xg_match_exact", sql(f'SELECT id, m."League", "Player", "xG", "xA" {_XG_JOIN}', "mp", "xl"))
def xg_match_exact(spark, sf):
    return matching.attach_xg(b.misspelt_players(spark, sf), b.name_xg(spark, sf), fuzzy=False).select("id", "League", "Player", "xG", "xA")


_XG_FUZZY = f"""{_XG_JOIN}
LEFT JOIN (SELECT fx."League" AS lg, fx.norm_l, xl."xG" AS fg, xl."xA" AS fa FROM fx JOIN xl ON xl."League" = fx."League" AND xl.norm = fx.norm_r
  WHERE {edit_sql(sorted_sql('fx.norm_l'), sorted_sql('fx.norm_r'))} >= 60) f ON f.lg = m."League" AND f.norm_l = m.n"""


@query("xg_fuzzy_token_gate", sql(f"""
SELECT id, m."League", "Player", coalesce("xG", fg) AS "xG", coalesce("xA", fa) AS "xA" {_XG_FUZZY}""", "mp", "xl", "fx"))
def xg_fuzzy_token_gate(spark, sf):
    return matching.attach_xg(b.misspelt_players(spark, sf), b.name_xg(spark, sf)).select("id", "League", "Player", "xG", "xA")


@query("match_rate", sql(f"""
SELECT m."League", count(*) AS players, count("xG") AS matched, round(count("xG") / count(*)::DOUBLE, 6) AS rate,
  count("xG") / count(*)::DOUBLE < 0.70::DOUBLE AS low {_XG_JOIN} GROUP BY 1""", "mp", "xl"))
def match_rate(spark, sf):
    d = matching.attach_xg(b.misspelt_players(spark, sf), b.name_xg(spark, sf), fuzzy=False)
    return matching.match_rate(d).withColumn("rate", F.round("rate", 6))


# --- parsing ---------------------------------------------------------------------

@query("money_parse", """
SELECT c_custkey, round(CASE c_custkey % 7
  WHEN 0 THEN round(c_acctbal / 100, 2) * 1000000 WHEN 1 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) * 1000.0::DOUBLE
  WHEN 2 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) * 1000.0::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN NULL
  WHEN 5 THEN NULL ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END, 2) AS eur
FROM (SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer)""")
def money_parse(spark, sf):
    v = F.abs("c_acctbal")
    whole = F.floor(v).cast("string")
    how = F.col("c_custkey") % 7
    raw = (
        F.when(how == 0, F.concat(F.lit("€"), F.replace(F.round(v / 100, 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("m")))
        .when(how == 1, F.concat(F.lit("€"), whole, F.lit("k")))
        .when(how == 2, F.concat(F.lit("€"), whole, F.lit("Th.")))
        .when(how == 3, "-").when(how == 4, "").when(how == 5, F.concat(F.lit("€"), whole, F.lit("bn")))
        .otherwise(F.concat(F.lit("€"), whole))
    )
    return b.table(spark, sf, "customer").select("c_custkey", F.round(parse.parse_money(raw), 2).alias("eur"))


@query("comma_number", "SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS n FROM orders")
def comma_number(spark, sf):
    shown = F.format_number(F.floor("o_totalprice"), 0)
    return b.table(spark, sf, "orders").select("o_orderkey", parse.comma_number(shown).alias("n"))


@query("coerce_numeric", """
SELECT p_partkey, p_size::DOUBLE AS size, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand, NULL::DOUBLE AS kind, round(p_retailprice, 2) AS price FROM part""")
def coerce_numeric(spark, sf):
    p = b.table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("string").alias("size"),
        F.substring_index("p_brand", "#", -1).alias("brand"), F.col("p_type").alias("kind"),
        F.round("p_retailprice", 2).alias("price"),
    )
    return rollup.coerce_numeric(p, keep=("p_partkey",))


_TOKENS = {"click": "F M", "view": "D M", "signup": "GK", "purchase": "M S", "error": ""}


@query("position_tokens", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'FW' WHEN 'view' THEN 'DF' WHEN 'signup' THEN 'GK' ELSE 'MF' END AS pos,
  CASE event_type WHEN 'click' THEN 'FW' WHEN 'signup' THEN 'GK' ELSE 'MF' END AS api_pos FROM events""")
def position_tokens(spark, sf):
    from ..config import API_POSITIONS

    word = {"click": "Attacker", "signup": "Goalkeeper", "view": "Sweeper", "purchase": "Midfielder", "error": ""}
    return b.table(spark, sf, "events").select(
        "event_id", text.xg_position(text.mapped(c("event_type"), _TOKENS, F.lit(""))).alias("pos"),
        text.mapped(text.mapped(c("event_type"), word, F.lit("")), API_POSITIONS, F.lit("MF")).alias("api_pos"),
    )


@query("primary_position", "SELECT c_custkey, c_mktsegment AS pos FROM customer")
def primary_position(spark, sf):
    both = F.concat(F.lit(" "), c("c_mktsegment"), F.lit(" ,MF"))
    return b.table(spark, sf, "customer").select("c_custkey", text.primary_position(both).alias("pos"))


@query("season_label", """
SELECT o_orderkey, right(CAST(y AS VARCHAR), 2) || right(CAST(y + 1 AS VARCHAR), 2) AS short, y || '-' || (y + 1) AS long
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def season_label(spark, sf):
    y = F.year("o_orderdate")
    label = F.concat_ws("-", y.cast("string"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    return b.table(spark, sf, "orders").select("o_orderkey", text.season_short(label).alias("short"), text.season_long(label).alias("long"))


# --- nested items and pages ------------------------------------------------------

def api_items(spark, sf) -> DataFrame:
    """An API item per event, numbers from its value and props, some of them absent."""
    k = F.get_json_object("props", "$.k")
    kind = c("event_type")
    return b.table(spark, sf, "events").select(
        "event_id",
        F.to_json(F.struct(
            F.struct(F.when(kind != "error", F.concat(F.lit("user "), c("user_id").cast("string"))).otherwise("").alias("name")).alias("player"),
            F.when(kind != "view", F.array(F.struct(
                F.struct(kind.alias("name")).alias("team"),
                F.struct(F.when(kind == "click", "Attacker").otherwise("Coach").alias("position")).alias("games"),
                F.struct(k.cast("int").alias("saves")).alias("goals"),
                F.struct(F.when(kind == "signup", "").otherwise(k).alias("on")).alias("shots"),
                F.struct(F.concat(k, F.lit("%")).alias("accuracy")).alias("passes"),
                F.struct(F.floor("value").alias("total")).alias("tackles"),
            ))).alias("statistics"),
        )).alias("item"),
        F.lit("2023-24").alias("season"),
    )


@query("json_flatten", """
SELECT "Player", CASE WHEN v THEN '' ELSE event_type END AS "Squad", CASE WHEN event_type = 'click' THEN 'FW' ELSE 'MF' END AS "Pos",
  CASE WHEN v THEN 0 ELSE k END AS "Saves", CASE WHEN v OR event_type = 'signup' THEN 0 ELSE k END AS "SoT",
  CASE WHEN v THEN NULL ELSE k END AS "Cmp%", CASE WHEN v THEN 0 ELSE floor(value) END AS "Tkl", 0::DOUBLE AS "Fld"
FROM (SELECT 'user ' || user_id AS "Player", event_type, event_type = 'view' AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value
  FROM events WHERE event_type <> 'error')""")
def json_flatten(spark, sf):
    return items.flatten_api_items(api_items(spark, sf)).select("Player", "Squad", "Pos", "Saves", "SoT", "Cmp%", "Tkl", "Fld")


@query("xg_items_flatten", """
SELECT 'user ' || user_id AS "Player", '' AS "Squad", CASE event_type WHEN 'click' THEN 'FW' WHEN 'view' THEN 'DF' WHEN 'signup' THEN 'GK' ELSE 'MF' END AS "Pos",
  round(value, 6) AS "Min", CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS "xG", 0::DOUBLE AS "xA", '2024-25' AS season FROM events""")
def xg_items_flatten(spark, sf):
    e = b.table(spark, sf, "events").select(
        F.concat(F.lit("user "), c("user_id").cast("string")).alias("player_name"),
        text.mapped(c("event_type"), _TOKENS, F.lit("")).alias("position"),
        F.round("value", 6).cast("string").alias("time"),
        F.when(c("event_type") == "error", "").otherwise(F.get_json_object("props", "$.k")).alias("xG"),
    )
    return items.flatten_xg_items(e, "2024-25")


_A = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""
_LINKS = rf"""
SELECT page_id, id, slug, name FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY nr) AS rn FROM (
    SELECT page_id, nr, name, split_part(string_split(href, '//')[2], '/', 1) AS id,
      split_part(regexp_replace(href, '^/+', ''), '/', 1) AS slug
    FROM (SELECT page_id, nr, regexp_extract(a, '{_A}', 1) AS href,
        trim(regexp_replace(regexp_extract(a, '{_A}', 2), '(?s)<[^>]*>', '', 'g')) AS name
      FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS nr
        FROM (SELECT page_id, regexp_extract_all(html, '{_A}') AS l FROM pages)))
    WHERE len(string_split(href, '//')) = 2) WHERE id <> '')
WHERE rn = 1"""


@query("page_links", _LINKS.replace("'//'", "'/'"))
def page_links(spark, sf):
    return items.page_links(b.table(spark, sf, "pages"), marker="/").select("page_id", "id", "slug", "name")


@query("pages_without_table", """SELECT page_id FROM pages WHERE NOT regexp_matches(html, '<table[^>]*stats_standard')""")
def pages_without_table(spark, sf):
    return html.pages_without(b.table(spark, sf, "pages"), "stats_standard")


def by_order(spark, sf):
    """Lines grouped by order on every core: parsing needs far more time per byte than scanning."""
    lines = b.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "page_id")
    return spread(lines, "page_id").groupBy("page_id")


def stat_pages(spark, sf) -> DataFrame:
    """One page per order: its lines as a stat table, in a comment for even orders."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    head = (
        '<table id="stats_standard"><thead><tr><th colspan="3"></th><th colspan="2">Playing Time</th></tr>'
        "<tr><th>Rk</th><th>Player</th><th>Squad</th><th>Min</th><th>Gls</th></tr></thead><tbody>"
    )
    again = "<tr><th>Rk</th><th>Player</th><th>Squad</th><th>Min</th><th>Gls</th></tr>"

    def row(x):
        cells = [
            F.lit("1"), F.concat(F.lit("Part &amp; "), x["l_partkey"].cast("string")),
            F.concat(F.lit("<a href='/s'>S "), x["l_suppkey"].cast("string"), F.lit("</a>")),
            F.format_number(F.floor(x["l_extendedprice"]), 0), x["l_quantity"].cast("int").cast("string"),
        ]
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v, F.lit("</td>")) for v in cells], F.lit("</tr>"))

    rows = F.array_join(F.transform(F.array_sort(F.collect_list(line)), row), again)
    t = F.concat(F.lit(head), rows, F.lit("</tbody></table>"))
    page = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<html><body><!-- "), t, F.lit(" --></body></html>"))).otherwise(
        F.concat(F.lit("<html><body><div>"), t, F.lit("</div></body></html>"))
    )
    return by_order(spark, sf).agg(page.alias("html"))


@query("page_stat_table", """
SELECT l_orderkey AS page_id, 'Part & ' || l_partkey AS "Player", 'S ' || l_suppkey AS "Squad", floor(l_extendedprice)::DOUBLE AS "Min",
  CAST(CAST(l_quantity AS INT) AS VARCHAR) AS "Gls" FROM lineitem WHERE floor(l_extendedprice) >= 900""")
def page_stat_table(spark, sf):
    t = html.stat_table(stat_pages(spark, sf), "stats_standard", ["Player", "Squad", "Min", "Gls"])
    return files.clean_stat_table(t, "stats_standard").select("page_id", "Player", "Squad", "Min", "Gls")


@query("page_stat_headers", """
SELECT l_orderkey AS page_id, l_orderkey % 5 <> 0 AS table_found,
  CASE WHEN l_orderkey % 5 <> 0 THEN 'Part & ' || l_partkey END AS "Player",
  CASE WHEN l_orderkey % 5 <> 0 THEN 'S ' || l_suppkey END AS "Squad",
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS "Gls"
FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT DISTINCT l_orderkey, false, NULL, NULL, NULL FROM lineitem WHERE l_orderkey % 5 = 0""")
def page_stat_headers(spark, sf):
    """Pages with two header rows and, for every third order, one; every fifth page lacks the table and says so."""
    group = '<tr><th colspan="3"></th><th colspan="2">Playing Time</th></tr>'
    p = F.col("page_id")
    one = F.when(p % 3 == 0, F.replace("html", F.lit(group), F.lit(""))).otherwise(F.col("html"))
    other = F.when(p % 5 == 0, F.replace(one, F.lit("stats_standard"), F.lit("stats_misc"))).otherwise(one)
    pages = stat_pages(spark, sf).select("page_id", other.alias("html"))
    return html.stat_table(pages, "stats_standard", ["Player", "Squad", "Gls"], report_absent=True).drop("row_ix")


def squad_pages(spark, sf) -> DataFrame:
    """One page per supplier nation's order: players linked, values in the last cell."""
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")

    def row(x):
        name = F.when(x["l_returnflag"] == "N", "").otherwise(F.concat(F.lit("Part "), x["l_partkey"].cast("string")))
        return F.concat(
            F.lit('<tr class="odd"><td class="hauptlink"><a href="#">7</a></td><td class="posrela"><table><tr>'
                  '<td class="x hauptlink"><a href="/p">'), name,
            F.lit("</a></td></tr><tr><td>Keeper</td></tr></table></td>"),
            # the value of a row without a name has no link
            F.when(x["l_returnflag"] == "N", '<td class="rechts">€').otherwise('<td class="rechts hauptlink"><a href="/v">€'),
            F.floor(x["l_extendedprice"] / 1000).cast("string"), F.lit("k</a></td></tr>"),
        )

    rows = F.array_join(F.transform(F.array_sort(F.collect_list(line)), row), "")
    page = F.concat(F.lit('<table class="items"><tr><th>Player</th><th></th><th>Value</th></tr>'), rows, F.lit("</table>"))
    return by_order(spark, sf).agg(page.alias("html"))


@query("page_squad_rows", """
SELECT l_orderkey AS page_id, 'Part ' || l_partkey AS player_name_tm,
  CASE WHEN l_extendedprice >= 0 THEN floor(l_extendedprice / 1000) * 1000 END AS market_value_eur
FROM lineitem WHERE l_returnflag <> 'N'""")
def page_squad_rows(spark, sf):
    r = html.squad_rows(squad_pages(spark, sf))
    return r.select("page_id", "player_name_tm", parse.parse_money(c("market_value_raw")).alias("market_value_eur"))


@query("page_club_links", """
SELECT l_orderkey AS page_id, CAST(l_suppkey AS VARCHAR) AS id, 'club-' || l_suppkey AS slug, 'Club & ' || l_suppkey AS name
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)""")
def page_club_links(spark, sf):
    """One page per order: its suppliers as clubs, with crest, menu and comment links around them."""
    line = F.struct("l_linenumber", "l_suppkey")

    def row(x):
        key = x["l_suppkey"].cast("string")
        target = F.concat(F.lit('<a href="/club-'), key, F.lit("/startseite/verein/"), key, F.lit('/saison_id/2024">'))
        return F.concat(
            F.lit('<tr class="odd"><td class="zentriert">'), target, F.lit('<img src="c.png"></a></td><td class="hauptlink no-border">'),
            target, F.lit("Club &amp; "), key, F.lit("</a></td></tr>"),
        )

    rows = F.array_join(F.transform(F.array_sort(F.collect_list(line)), row), "")
    page = F.concat(
        F.lit('<a href="/menu/startseite/verein/9">Menu</a><!-- <table class="items"><tr><td class="hauptlink">'
              '<a href="/old/startseite/verein/77">Old</a></td></tr></table> --><table class="items">'),
        rows, F.lit("</table>"),
    )
    return html.club_links(by_order(spark, sf).agg(page.alias("html")))


def standings_pages(spark, sf) -> DataFrame:
    """The league tables printed as pages, one per league and season."""
    row = F.struct("Rk", "Squad", "Pts")
    t = b.standings(spark, sf)
    rows = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(row)),
            lambda x: F.concat(F.lit("<tr><td>"), x["Rk"].cast("string"), F.lit("</td><td>"), x["Squad"], F.lit("</td><td>"), x["Pts"].cast("string"), F.lit("</td></tr>")),
        ), "",
    )
    page = F.concat(
        F.lit("<table><tr><th>Day</th></tr><tr><td>1</td></tr></table><!-- <table><tr><th>Rk</th><th>Squad</th><th>Pts</th></tr>"),
        rows, F.lit("<tr><td></td><td>Total</td><td></td></tr></table> -->"),
    )
    return t.groupBy("League", "season").agg(page.alias("html")).select(F.concat_ws(" ", "League", "season").alias("page_id"), "html")


@query("page_standings", sql("""SELECT "League" || ' ' || season AS page_id, CAST("Rk" AS INT) AS "Rk", "Squad" FROM st""", "st"))
def page_standings(spark, sf):
    return html.standings_rows(standings_pages(spark, sf))


# --- file sources ----------------------------------------------------------------

@query("csv_roundtrip", sql('SELECT "League", season, "Player", "Min", "Gls", "xG" FROM cs', "cs"))
def csv_roundtrip(spark, sf):
    names = ["Player", "Min", "Gls", "xG"]
    path = scratch_path(spark)
    files.write_table(b.cust_season(spark, sf).select("League", "season", *names), path, "csv")
    schema = files.text_schema([*names, "League", "season"])
    back = spark.read.schema(schema).option("header", True).csv(path)
    return rollup.coerce_numeric(back).select("League", "season", "Player", "Min", "Gls", "xG")
