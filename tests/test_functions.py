import unicodedata

import pytest
from pyspark.sql import functions as F

from scoutframe.config import API_POSITIONS, PILLARS, POSITIONS, pillars_of
from scoutframe.functions import parse, rates, text


def run(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def plain(name):
    kept = unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode()
    return " ".join(kept.lower().split())


def test_normalize_name(spark):
    names = ["Ødegaard", "Müller  Thomas ", "Özil\tX", "Łukasz", "strauß", "Ǻå ṩ", "K ≠", "São\x1cPaulo", "日本", ""]
    assert run(spark, names, text.normalize_name) == [plain(n) for n in names]
    assert run(spark, [None], text.normalize_name) == [""]


def test_every_accented_letter(spark):
    """All code points of the basic plane, a line each."""
    chars = [chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    lines = ["a" + "".join(chars[i : i + 256]) for i in range(0, len(chars), 256)]
    assert run(spark, lines, text.normalize_name) == [plain(x) for x in lines]


def test_normalize_club(spark):
    clubs = ["FC Barcelona", "Arsenal AFC", "Real Madrid", "Manchester City FC", "AFC Fc. x", None]
    assert run(spark, clubs, text.normalize_club) == ["barcelona", "arsenal", "real madrid", "manchester city", ". x", ""]


def test_positions(spark):
    assert run(spark, ["DF,MF", "GK", " FW , MF", None], text.primary_position) == ["DF", "GK", "FW", None]
    got = run(spark, ["F M", "D M", "GK", "G", "M S", "", None, "  ", "d f"], text.xg_position)
    assert got == ["FW", "DF", "GK", "GK", "MF", "MF", "MF", "GK", "FW"]
    api = run(spark, ["Attacker", "Coach", ""], lambda c: text.mapped(c, API_POSITIONS, F.lit("MF")))
    assert api == ["FW", "MF", "MF"]


def test_seasons_and_labels(spark):
    assert run(spark, ["2024-25"], text.season_short) == ["2425"]
    assert run(spark, ["2024-25", "1999-00"], text.season_long) == ["2024-2025", "1999-2000"]
    assert run(spark, ["Fld_p90", "Save%", "a_b"], text.stat_label) == ["Fld/90", "Save%", "a b"]


def test_age(spark):
    got = run(spark, ["25-201", "25", " 21 ", "N/A", None, "-5", "25.5"], parse.parse_age)
    assert got == [25.0, 25.0, 21.0, None, None, None, 25.5]


def test_money(spark):
    raw = ["€12.50m", "€500k", "€500Th.", "-", "", None, "€1,25m", "€2bn", "1234", "€900K", "m"]
    want = [12.5e6, 5e5, 5e5, None, None, None, 1.25e6, None, 1234.0, 9e5, None]
    assert run(spark, raw, parse.parse_money) == want


def test_numbers(spark):
    assert run(spark, ["1,234", "12", "x", None, "nan", "1d", "1e3", ".5"], parse.comma_number) == [
        1234.0, 12.0, None, None, None, None, 1000.0, 0.5]
    assert run(spark, ["", "x", "3"], parse.or_zero) == [0.0, 0.0, 3.0]
    assert run(spark, [float("nan"), 1.0], parse.clean_double, "double") == [None, 1.0]


@pytest.mark.parametrize("age,want", [("17", 1.3), ("25", 1.167), ("29", 1.0), ("35", 1.0), (None, 1.0), ("28", 1.0), ("0", 1.4065)])
def test_age_multiplier(spark, age, want):
    assert run(spark, [age], rates.age_multiplier)[0] == pytest.approx(want, abs=1e-3)


def test_rates_and_factors(spark):
    zero = spark.createDataFrame([(1.0, 0.0), (1.0, None), (10.0, 900.0)], "a double, m double")
    assert [r[0] for r in zero.select(rates.per90(F.col("a"), F.col("m"))).collect()] == [None, None, 1.0]
    assert run(spark, ["EPL", "Ligue1", "Other", None], rates.league_factor) == [1.10, 1.00, 1.0, 1.0]
    assert run(spark, [0.0, 33.0, 66.0], rates.traffic_band, "double") == ["red", "amber", "green"]


def test_pillar_weights_sum_to_one():
    for pos in POSITIONS:
        rules = pillars_of(pos)
        assert [r.name for r in rules] == list(PILLARS)
        assert sum(r.weight for r in rules) == 100
        for r in rules:
            assert sum(w for _, w in r.stats) == pytest.approx(1.0)
