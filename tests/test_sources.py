import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoutframe.session import scratch_path
from scoutframe.sources import files, html, items


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_stat_files(spark, tmp_path):
    d = tmp_path / "stats"
    head = ",".join(x.removesuffix(".1") for x in files.STAT_FILE_COLUMNS["stats_keeper"])
    row = "1,Ann,ENG,GK,Club,25,1999,30,30,{m},30,20,0.67,99,79,79.8,1,2,3,10,30,0,0,0,0,50,M"
    write(d, "src_EPL_stats_keeper_2023-24.csv", head + "\n" + row.format(m='"2,700"') + "\n")
    write(d, "src_LaLiga_stats_keeper_2024-25.csv", head + "\n" + row.format(m="899") + "\n")
    write(d, "src_EPL_stats_keeper_adv_2023-24.csv", "Rk,Player\n1,Other\n")
    raw = files.read_stat_table(spark, str(d), "stats_keeper")
    got = sorted(tuple(r) for r in raw.select("League", "season", "Player", "`Save%`", "`Save%.1`").collect())
    assert got == [("EPL", "2023-24", "Ann", "79.8", "50"), ("LaLiga", "2024-25", "Ann", "79.8", "50")]
    clean = files.clean_stat_table(raw, "stats_keeper")
    assert [(r["League"], r["Min"]) for r in clean.collect()] == [("EPL", 2700.0)]


def test_xag_is_renamed_in_the_standard_table_only(spark):
    d = spark.createDataFrame([("A", 1.0), ("", 2.0), (None, 3.0)], "Player string, xAG double")
    assert files.clean_stat_table(d, "stats_standard").columns == ["Player", "xA"]
    assert files.clean_stat_table(d, "stats_passing").columns == ["Player", "xAG"]
    assert files.clean_stat_table(d, "stats_passing").count() == 1


def test_values_xg_standings_matches(spark, tmp_path):
    v = tmp_path / "v"
    for season in ("2022-23", "2024-25"):
        write(v, f"tm_values_EPL_{season}.csv", f"player_name_tm,club_tm,season,market_value_eur\nA,C,{season},10.5\nB,C,{season},\n")
    assert [tuple(r) for r in files.read_values(spark, str(v)).collect()] == [("A", "C", 10.5, "2024-25", "EPL")]
    x = tmp_path / "x"
    write(x, "xgs_EPL_2024-25.csv", "Player,Squad,Pos,Min,xG,xA,season\nA,C,FW,900,1.5,,2024-25\n")
    write(x, "src_EPL_stats_keeper_2024-25.csv", "Rk,Player\n1,B\n")
    (r,) = files.read_xg(spark, str(x), "xgs").collect()
    assert (r["League"], r["xG"], r["xA"], r["season"]) == ("EPL", 1.5, None, "2024-25")
    s = tmp_path / "s"
    write(s, "src_EPL_standings_2024-25.csv", "Rk,Squad\n1,Liverpool\n")
    assert tuple(files.read_standings(spark, str(s)).first()) == ("EPL", "2024-25", 1, "Liverpool")
    write(s, "m.csv", "HomeTeam,AwayTeam,FTR\nA,B,H\n")
    write(s, "bad.csv", "HomeTeam,AwayTeam\nA,B\n")
    assert files.read_matches(spark, f"{s}/m.csv").count() == 1
    with pytest.raises(ValueError):
        files.read_matches(spark, f"{s}/bad.csv")


def test_repeated_headers():
    assert files.unique_names(["Gls", "Ast", "Gls", "Gls"]) == ["Gls", "Ast", "Gls.1", "Gls.2"]


def test_freshness(spark, tmp_path):
    d = tmp_path / "f"
    write(d, "old.csv", "a\n1\n")
    write(d, "new.csv", "a\n2\n")
    os.utime(d / "old.csv", (1_000_000_000, 1_000_000_000))
    stamp = time.strftime("%Y", time.gmtime())
    assert stamp in files.source_freshness(spark, f"{d}/*.csv").first()[0]
    assert files.source_freshness(spark, f"{d}/*.parquet").first()[0] == files.NO_SOURCE
    fresh = files.read_csv(spark, f"{d}/*.csv", ["a"], modified_after="2020-01-01T00:00:00")
    assert [r[0] for r in fresh.collect()] == ["2"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sink_round_trip(spark, fmt):
    d = spark.createDataFrame([("L", "s", "A,\"x\"", 1.5), ("M", "t", "B", None)], "League string, season string, Player string, v double")
    path = scratch_path(spark)
    files.write_table(d, path, fmt)
    back = spark.read.schema("Player string, v double, League string, season string").option("header", True).format(fmt).load(path)
    assert sorted(tuple(r) for r in back.select(*d.columns).collect()) == sorted(tuple(r) for r in d.collect())
    files.write_table(d.where("season = 't'").withColumn("v", F.lit(2.5)), path, fmt)
    again = spark.read.schema("Player string, v double, League string, season string").option("header", True).format(fmt).load(path)
    assert sorted((r["season"], r["v"]) for r in again.collect()) == [("s", 1.5), ("t", 2.5)]


def test_a_file_with_another_header_is_an_error(spark, tmp_path):
    write(tmp_path, "src_EPL_standings_2024-25.csv", "Squad,Rk\nLiverpool,1\n")
    with pytest.raises(Exception, match="Rk"):
        files.read_standings(spark, str(tmp_path)).collect()


def test_nested_squad_rows_and_scoped_links(spark):
    row = (
        '<tr class="odd"><td class="zentriert"><a href="/c/verein/3"><img></a></td><td><table><tr><td class="hauptlink">'
        '<a href="/e">Ederson</a></td></tr><tr><td>Keeper</td></tr></table></td><td class="rechts hauptlink"><a>35.00m</a></td></tr>'
        '<tr class="even"><td class="hauptlink"><a href="/city/x/verein/281/s">City &amp; Co</a></td></tr>'
    )
    text = f'<a href="/nav/verein/9">Nav</a><!-- <a href="/old/verein/77">x</a> --><table class="items">{row}</table>'
    first = html.squad_rows(page(spark, text)).orderBy("row_ix").first()
    assert (first["player_name_tm"], first["market_value_raw"]) == ("Ederson", "35.00m")
    links = html.club_links(page(spark, text)).select("id", "slug", "name").collect()
    assert [tuple(r) for r in links] == [("281", "city", "City & Co")]


STATS = """<html><body><div id="x"><!-- <p>ad</p> <table class="stats" id="stats_standard"><thead>
<tr><th colspan="2"></th><th colspan="3">Playing Time</th><th>Per 90</th></tr>
<tr><th>Rk</th><th>Player</th><th>Squad</th><th>Min</th><th>Gls</th><th>Gls</th></tr></thead><tbody>
<tr><td>1</td><td data-x="a>b"><a href="/p">Bukayo &amp; <b>Saka</b></a></td><td>Arsenal</td><td>2,500</td><td>14</td><td>0.5</td></tr>
<tr><th>Rk</th><th>Player</th><th>Squad</th><th>Min</th><th>Gls</th><th>Gls</th></tr>
<tr><td>2<td>Sub<td>Arsenal<td>200<td>0<td></tr></tbody></table> --></div>
<script>var s = '<table id="stats_standard"><tr><td>no</td></tr></table>';</script></body></html>"""
OTHER = "<table id=other><tr><th>a</th></tr><tr><td>1</td></tr></table>"


def page(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string")


def test_stat_table_in_a_comment(spark):
    t = html.stat_table(page(spark, STATS, OTHER, None), "stats_standard", ["Player", "Squad", "Min", "Gls", "Gls.1"])
    got = [tuple(r)[2:] for r in t.orderBy("row_ix").collect()]
    assert got == [("Bukayo & Saka", "Arsenal", "2,500", "14", "0.5"), ("Sub", "Arsenal", "200", "0", None)]
    assert [r["Player"] for r in files.clean_stat_table(t, "stats_standard").collect()] == ["Bukayo & Saka"]
    assert [r[0] for r in html.pages_without(page(spark, STATS, OTHER), "stats_standard").collect()] == [1]


def test_visible_table_comes_first(spark):
    seen = '<table id="stats_standard"><tr><th>Rk</th></tr><tr><th>Player</th></tr><tr><td>Seen</td></tr></table>'
    t = html.stat_table(page(spark, STATS.replace("</body>", seen + "</body>")), "stats_standard", ["Player"])
    assert [r["Player"] for r in t.collect()] == ["Seen"]


def test_spans_and_nesting(spark):
    text = "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3<table><tr><td>in</td></tr></table></td></tr></table>"
    cells = html.table_cells(page(spark, text), header_levels=1).where("table_ix = 0").orderBy("row_ix", "col_ix").collect()
    assert [(c["header"], c["text"]) for c in cells] == [("a", "1"), ("b", "2"), ("a", "1"), ("b", "3in")]


def test_header_depth_of_each_table_and_absent_tables(spark):
    group = STATS[STATS.index('<tr><th colspan="2">') : STATS.index("<tr><th>Rk")]
    plain = '<table id="stats_standard"><tr><td>g</td><td></td></tr><tr><td>Rk</td><td>Player</td></tr><tr><td>1</td><td>P</td></tr></table>'
    bare = '<table id="stats_standard"><tr><th>Rk</th><th>Player</th></tr></table>'
    pages = page(spark, STATS, STATS.replace(group, ""), plain, bare, OTHER, None, "")
    t = html.stat_table(pages, "stats_standard", ["Player", "Gls"], report_absent=True)
    got = [tuple(r) for r in t.orderBy("page_id", "row_ix").collect()]
    two = [(True, 0, "Bukayo & Saka", "14"), (True, 2, "Sub", "0")]
    assert got == [
        *[(0, *r) for r in two], *[(1, *r) for r in two], (2, True, 0, "P", None), (3, True, None, None, None),
        *[(i, False, None, None, None) for i in (4, 5, 6)],
    ]
    found = html.stat_table(pages, "stats_standard", ["Player", "Gls"]).orderBy("page_id", "row_ix").collect()
    assert [tuple(r) for r in found] == [(i, at, *r) for i, yes, at, *r in got if at is not None]


def test_spans_reach_down_as_intervals(spark):
    text = (
        "<table><tr><th>a</th><th>b</th><th>c</th><th>d</th></tr>"
        "<tr><td>1</td><td rowspan=3 colspan=2>m</td><td rowspan=2>e</td></tr><tr><td>2</td></tr><tr></tr>"
        "<tr><td>3</td><td>x</td></tr><tr><td>4</td><td colspan=9000000000>w</td></tr></table>"
    )
    cells = html.table_cells(page(spark, text), header_levels=1).orderBy("row_ix", "col_ix").collect()
    lines = [[x["text"] for x in cells if x["row_ix"] == i] for i in range(4)]
    assert lines[:3] == [["1", "m", "m", "e"], ["2", "m", "m", "e"], ["3", "m", "m", "x"]]
    assert lines[3][:2] == ["4", "w"] and len(lines[3]) == 1001


def test_squad_rows(spark):
    text = """<table class="x"></table><table class="big items"><tr class="head"><td>h</td></tr>
    <tr class="odd"><td class="hauptlink"><a>10</a></td><td class="a hauptlink"><a href="/s">Saka</a> x</td><td>RW</td><td>€1.5m</td></tr>
    <tr class="even"><td class="hauptlink"><a> </a></td><td>€2m</td></tr></table>"""
    got = html.squad_rows(page(spark, text).withColumn("club", F.lit("Arsenal")), keep=["club"]).collect()
    assert [(r["club"], r["player_name_tm"], r["market_value_raw"]) for r in got] == [("Arsenal", "Saka", "€1.5m")]


def test_standings_sources(spark):
    def t(n, attrs=""):
        body = "".join(f"<tr><td>{i}</td><td>{attrs or 'T'}{i}</td></tr>" for i in range(1, n + 1))
        return f"<table {attrs}><tr><th>Rk</th><th>Squad</th></tr>{body}<tr><td></td><td>Total</td></tr></table>"

    pages = page(spark, t(12) + f"<!-- {t(2)} -->" + t(3, "id=known"), t(4) + t(11), t(4) + f"<!-- {t(5)} -->")
    n = lambda known: {r["page_id"]: r["count"] for r in html.standings_rows(pages, known).groupBy("page_id").count().collect()}
    assert n("known") == {0: 3, 1: 11, 2: 5} and n(None) == {0: 2, 1: 11, 2: 5}


def test_links(spark):
    text = """<a class="c" href="/arsenal/start/verein/11/x">Arsenal <b>FC</b></a><a href='/b/verein/11'>Again</a>
    <a href="/chelsea/verein/631">Chelsea</a><a href="/news">n</a><a href="/z/verein/1/verein/2">two</a>"""
    got = sorted(tuple(r) for r in items.page_links(page(spark, text)).select("id", "slug", "name").collect())
    assert got == [("11", "arsenal", "Arsenal FC"), ("631", "chelsea", "Chelsea")]


def test_api_items(spark):
    full = {"player": {"name": "De Gea"}, "statistics": [{"team": {"name": "MU"}, "games": {"position": "Goalkeeper"},
            "goals": {"saves": 3, "conceded": None}, "passes": {"accuracy": "83%"}, "fouls": {"drawn": ""}}, {"goals": {"saves": 9}}]}
    rows = [(json.dumps(full), "s"), (json.dumps({"player": {"name": ""}}), "s"), (json.dumps({"player": {"name": "X"}, "statistics": []}), "s")]
    got = {r["Player"]: r for r in items.flatten_api_items(spark.createDataFrame(rows, "item string, season string")).collect()}
    assert set(got) == {"De Gea", "X"} and len(got["X"]) == 16
    g = got["De Gea"]
    assert (g["Squad"], g["Pos"], g["Saves"], g["GoalsConceded"], g["Cmp%"], g["Fld"]) == ("MU", "GK", 3.0, 0.0, 83.0, 0.0)
    assert (got["X"]["Squad"], got["X"]["Pos"], got["X"]["Saves"], got["X"]["Cmp%"]) == ("", "MF", 0.0, None)


def test_xg_items(spark):
    d = spark.createDataFrame([("A", None, "F M", "90", "1.5", "")], "player_name string, team_title string, position string, time string, xG string, xA string")
    assert tuple(items.flatten_xg_items(d, "2024-25").first()) == ("A", "", "FW", 90.0, 1.5, 0.0, "2024-25")
    assert len(items.flatten_xg_items(d, "2024-25", wide=True).columns) == 14


def test_pages_are_parsed_in_bounded_slices():
    """A slice has a bounded number of pages and of characters; a longer page is one of its own; no page is lost."""
    pages = ["x" * n for n in (1, 2, 3)] + [None, "y" * (html.SLICE_CHARS + 5), "z"] + ["w"] * (2 * html.SLICE_PAGES)
    parts = list(html._slices(pa.RecordBatch.from_pydict({"_html": pa.array(pages, pa.string())})))
    assert [x for p in parts for x in p.column("_html").to_pylist()] == pages
    assert max(p.num_rows for p in parts) == html.SLICE_PAGES
    assert parts[1].num_rows == 1 and len(parts[1].column("_html")[0].as_py()) > html.SLICE_CHARS
    assert list(html._slices(pa.RecordBatch.from_pydict({"_html": pa.array([], pa.string())}))) == []


def test_a_cell_of_text_alone_is_one_token():
    """And reads as one that is opened and closed in two, entities, case, missing row and nested tables included."""
    assert len(html._TAG.findall("<tr><td>1</td><td>2</td></tr>")) == 4
    for source in ("<tr><td>1 &amp;\n2</td><TH>x</TH><td>y</td></tr>", "<td>no row</td><tr><td>a<table><tr><td>b</td></tr></table></td></tr>"):
        split = source.replace("<td>", "<td >").replace("<TH>", "<TH >")
        assert pa.array(html._page_tables(f"<table>{source}</table>", 0), pa.list_(html._TABLE).value_type) == pa.array(
            html._page_tables(f"<table>{split}</table>", 0), pa.list_(html._TABLE).value_type
        )
