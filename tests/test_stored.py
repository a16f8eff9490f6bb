"""Stored tables: pruning, increments, mergeable state, the name index and the observed rate."""

import os
import time

import pytest
from pyspark.sql import functions as F

from scoutframe.operators import matching, rollup, rollup_state, search_index
from scoutframe.operators.standings import attach_rank
from scoutframe.plans import stored_queries
from scoutframe.sources import catalog, files, incremental

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    """The plan that ran, in full."""
    df.collect()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def stats(spark, rows):
    return spark.createDataFrame(
        rows, "League string, season string, Player string, Squad string, Pos string, Age string, Gls double, Min double, Rk int"
    )


ROWS = [
    ("A", "2022-23", "x", "c1", "FW", "20", 1.0, 900.0, 1), ("A", "2022-23", "y", "c1", "MF", "21", 2.0, 50.0, 2),
    ("A", "2023-24", "x", "c2", "FW,MF", "21", 4.0, 800.0, 1), ("B", "2022-23", "x", "c9", None, None, None, 10.0, 1),
    ("B", "2023-24", "z", None, "GK", "30", 0.0, 90.0, 1), ("A b", "2023-24", "x", "c3", "DF", "19", 3.0, 9.0, 1),
]


def test_catalogue_prunes_by_literal_and_by_join(spark, tmp_path):
    df = stats(spark, ROWS)
    catalog.store_tables({"stats_standard": df}, str(tmp_path))
    got = catalog.read_table(spark, str(tmp_path), "stats_standard", leagues=["A", "A b"], seasons=["2023-24"])
    assert sorted((r.League, r.Player, r.Gls) for r in got.collect()) == [("A", "x", 4.0), ("A b", "x", 3.0)]
    wanted = spark.createDataFrame([("B", 1), ("A", 2)], "League string, n int").where("n = 1")
    joined = catalog.only_keys(catalog.read_table(spark, str(tmp_path), "stats_standard", seasons=["2022-23"]), wanted)
    assert [(r.League, r.season, r.Player) for r in joined.collect()] == [("B", "2022-23", "x")]
    # one league and season loaded again replaces just that one
    catalog.store_tables({"stats_standard": stats(spark, [("A", "2022-23", "new", "c", "FW", "1", 9.0, 9.0, 1)])}, str(tmp_path))
    every = catalog.read_table(spark, str(tmp_path), "stats_standard")
    assert sorted((r.League, r.Player) for r in every.collect()) == [("A", "new"), ("A", "x"), ("A b", "x"), ("B", "x"), ("B", "z")]


def test_catalogue_query_has_both_partition_filters(spark, tmp_path):
    stored_queries.catalog.store_tables(
        {"stats_standard": stored_queries.b.cust_season(spark, SF).select("League", "season", "Player", "Gls", "xG")}, str(tmp_path)
    )
    plan = executed(stored_queries.pruned_read(spark, SF, str(tmp_path)))
    pruned = [x for x in plan.splitlines() if x.startswith("PartitionFilters: [") and "dynamicpruning" in x]
    assert pruned and all("season" in x and "League" in x for x in pruned)


def test_merged_seasons_equal_the_roll_up(spark, tmp_path):
    df, path = stats(spark, ROWS), str(tmp_path)
    first = df.where("season = '2022-23'")
    rollup_state.merge_seasons(spark, path, first.withColumn("Gls", F.lit(77.0)))  # wrong, to be replaced
    rollup_state.merge_seasons(spark, path, df.where("season = '2023-24'"))
    rollup_state.merge_seasons(spark, path, first)
    columns = ["League", "Player", "Gls", "Min", "Squad", "Pos", "Age", "single_season", "last_season"]
    got = sorted(map(tuple, rollup_state.stored_rollup(spark, path).select(*columns).collect()), key=repr)
    assert got == sorted(map(tuple, rollup.season_rollup(df).select(*columns).collect()), key=repr)
    # totals of other leagues are not written again
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/table_type=totals/League=B") for f in fs}
    rollup_state.merge_seasons(spark, path, df.where("League = 'A' and season = '2023-24'"))
    assert before == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/table_type=totals/League=B") for f in fs}


def test_new_and_changed_files_only(spark, tmp_path):
    path, state = str(tmp_path / "data"), str(tmp_path / "state")

    def put(name, rows, at):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "w") as f:
            f.write("k\n" + "\n".join(rows) + "\n")
        os.utime(f"{path}/{name}", (at, at))

    def take():
        rows, batch = incremental.read_new(spark, lambda p: spark.read.schema("k string").option("header", True).csv(p), path, state)
        got = sorted(r.k for r in rows.collect())
        incremental.take_in(rows, batch, state)
        return batch, got

    now = int(time.time()) - 1000
    put("a.csv", ["1", "2"], now)
    put("b.csv", ["3"], now + 5)
    assert take() == (1, ["1", "2", "3"])
    assert take()[1] == []
    put("c.csv", ["4"], now + 5)  # as old as the newest listed one
    put("a.csv", ["5"], now + 9)  # changed
    assert take()[1] == ["4", "5"]
    seen = {(r.file.rsplit("/", 1)[1], r.rows) for r in incremental.taken_in(spark, state).collect()}
    assert seen == {("a.csv", 2), ("b.csv", 1), ("c.csv", 1), ("a.csv", 1)}


def test_freshness_without_files(spark, tmp_path):
    assert files.source_freshness(spark, f"{tmp_path}/*.csv").first()[0] == files.NO_SOURCE
    (tmp_path / "x.csv").write_text("a\n1\n")
    os.utime(tmp_path / "x.csv", (1_700_000_000, 1_700_000_000))
    assert files.source_freshness(spark, f"{tmp_path}/*.csv").first()[0] == "14 Nov 2023, 22:13"


def test_indexed_search_equals_a_scan(spark, tmp_path):
    names = ["Ødegård Jr", "Álvaro", "alvar", "an", "a_b%c", "Kim Min-jae", "Minjae Kim", "", None, "x" * 300 + "alvaro"]
    df = spark.createDataFrame([("L", n) for n in names], "League string, Player string")
    search_index.build_name_index(df, str(tmp_path))
    for pattern in ("alvar", "ÁLVAR", "an", "", "  ", "min", "kim%min", "min%kim", "n-j", "zzz", "a_b", "alvaro", "%", "x%alv"):
        norm = [(p.lower().replace("á", "a")).strip() for p in pattern.split("%")]
        want = []
        for n in names:
            text, at = (n or "").lower().replace("á", "a").replace("ø", "").replace("å", "a"), 0
            for p in norm:
                at = text.find(p, at) + len(p) if at >= 0 and text.find(p, at) >= 0 else -1
            want += [n] if at >= 0 else []
        got = [r.Player for r in search_index.search_names(spark, str(tmp_path), pattern).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), pattern
    plan = executed(search_index.search_names(spark, str(tmp_path), "alvaro"))
    assert "PushedFilters: [In(gram" in plan


def test_the_observed_rate_costs_no_pass(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("B", 2.0), ("B", 2.0), ("C", None)], "League string, xG double")
    d, seen = matching.observe_match_rate(df, ["A", "B", "C", "D"])
    assert d.count() == 5
    got = sorted(map(tuple, matching.observed_match_rate(spark, seen, ["A", "B", "C", "D"]).collect()))
    assert got == sorted(map(tuple, matching.match_rate(df).collect()))
    assert seen.get["players"] == 5 and seen.get["matched"] == 3


def test_last_loaded_standing_counts(spark, tmp_path):
    (tmp_path / "src_L one_standings_2023-24.csv").write_text("Rk,Squad\n1,c1\n9,c2\n3,c2\n")
    s = files.read_standings(spark, str(tmp_path))
    assert sorted((r.League, r.season, r.Squad, r.Rk) for r in s.collect()) == [
        ("L one", "2023-24", "c1", 1), ("L one", "2023-24", "c2", 3)
    ]
    again = spark.createDataFrame([("L one", "c1", 5, 0), ("L one", "c1", 2, 1)], "League string, Squad string, Rk int, loaded int")
    assert attach_rank(again.select("League", "Squad").distinct(), again).first().league_position == 2.0
    players = spark.createDataFrame([("L one", "c1"), ("L one", "c2"), ("L one", "2 Clubs")], "League string, Squad string")
    assert {r.Squad: r.league_position for r in attach_rank(players, s).collect()} == {"c1": 1.0, "c2": 3.0, "2 Clubs": None}


@pytest.mark.parametrize("name", ["batch_valuation", "stored_stat_files", "stored_standings_files", "incremental_files", "value_rank"])
def test_stored_queries_equal_their_sql(spark, name):
    import check_oracles

    assert check_oracles.compare(spark, check_oracles.oracle_connection(SF), name, SF) is None
