"""The whole batch on a small league, and the registered queries on real tables."""

import json

import pytest
from pyspark.sql import functions as F

from scoutframe.operators.standings import league_table
from scoutframe.plans.valuation import build_dataset, value_players

KEY = "League string, season string, Player string, Squad string, Pos string, Age string"


def tables(spark):
    std, misc, keeper = [], [], []
    for lg in ("EPL", "LaLiga"):
        for i in range(12):
            pos = ("FW", "MF", "DF,MF", "GK")[i % 4]
            for season in ("2023-24", "2024-25"):
                k = (lg, season, f"{lg} Player {'abcdefghijkl'[i]}", f"{lg} Club{i % 3}", pos, f"{20 + i}-100")
                std.append((*k, "1,000" if i else "500", float(i % 5), float(i % 3)))
                misc.append((*k, float(i), float(i % 4), 3.0))
                if pos == "GK":
                    keeper.append((*k, 30.0 + i, 10.0))
    std.append(("EPL", "2023-24", "EPL Gone Man", "EPL Club0", "FW", "33-001", "3,000", 9.0, 9.0))
    make = spark.createDataFrame
    return {
        "stats_standard": make(std, KEY + ", Min string, Gls double, Ast double").withColumn("Min", F.replace("Min", F.lit(","), F.lit(""))),
        "stats_misc": make(misc, KEY + ", Fld double, Crs double, TklW double"),
        "stats_keeper": make(keeper, KEY + ", Saves double, GA double"),
    }


def values(spark):
    v = [(f"{lg} Player {c}", f"{lg} Club", 1e6 * (1 + i), "2024-25", lg) for lg in ("EPL", "LaLiga") for i, c in enumerate("abcdefghijkl")]
    return spark.createDataFrame(v, "player_name_tm string, club_tm string, market_value_eur double, season string, league_tm string")


def matches(spark):
    m = [(lg, "2024-25", f"{lg} Club{a}", f"{lg} Club{b}", "H", 2, 1) for lg in ("EPL", "LaLiga") for a, b in ((0, 1), (0, 2), (1, 2))]
    return spark.createDataFrame(m, "League string, season string, HomeTeam string, AwayTeam string, FTR string, FTHG int, FTAG int")


def test_whole_batch(spark):
    xg = spark.createDataFrame([("EPL", "EPL Player e", 5.0, 2.0)], "League string, Player string, xG double, xA double")
    out = value_players(tables(spark), values(spark), xg, league_table(matches(spark), names={})).toPandas()
    assert len(out) == 22  # without the 1000-minute players and the one who left
    assert not out.Player.str.contains("Gone").any() and set(out.Pos) == {"GK", "FW", "MF", "DF"}
    assert out.scout_score.between(0, 100).all() and out.uv_score.between(0, 100).all()
    assert out.groupby("Pos").residual.sum().abs().max() < 1e-9
    assert set(out.league_position) == {1.0, 2.0, 3.0}
    assert out.set_index("Player").loc["EPL Player e", "xG"] == 5.0
    assert set(out.league_quality_multiplier) == {1.10, 1.08}
    for r in out.itertuples():
        peers = [p["player"] for p in json.loads(r.similar_players)]
        assert len(peers) == min(5, (out.Pos == r.Pos).sum() - 1) and r.Player not in peers


def test_empty_inputs_and_single_season(spark):
    assert build_dataset({}, None) is None
    one = {n: t.where("season = '2024-25'") for n, t in tables(spark).items()}
    d = build_dataset(one, None)  # 900 minutes suffice for one season
    assert d.count() == 22 and d.where("single_season").count() == 22
    assert d.where("market_value_eur IS NOT NULL OR league_position IS NOT NULL").count() == 0


QUICK = ("season_rollup", "star_join_nine", "league_table", "uv_score", "similar_top5", "profile_percentiles",
         "radar", "comparison_pivot", "money_parse", "page_links", "page_stat_table", "json_flatten")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    from check_oracles import compare, oracle_connection

    sf = "/root/testdata/sf0.001"
    assert compare(spark, oracle_connection(sf), name, sf) is None
