"""DuckDB SQL for the registered queries, composed from shared CTEs."""

from __future__ import annotations

from ..config import PER90_STATS, PILLARS, POSITIONS, SUM_STATS, pillars_of, stats_of
from .bindings import LEAGUE_FACTOR_OF, MATCH_RESULT_OF, PER_SEASON, POSITION_OF

NORMED = tuple(dict.fromkeys(s for p in POSITIONS for s in stats_of(p)))


def q(name: str) -> str:
    return '"' + name + '"'


def _case(col: str, table: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _for_pos(expr) -> str:
    return 'CASE "Pos" ' + " ".join(f"WHEN '{p}' THEN {expr(p)}" for p in POSITIONS) + " END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


cte("dim", (), f"""
SELECT c_custkey, c_name AS "Player", n_name AS "Squad", r_name AS "League",
  {_case('c_mktsegment', POSITION_OF)} AS "Pos",
  concat(17 + c_custkey % 22, '-', lpad(CAST(c_custkey % 365 AS VARCHAR), 3, '0')) AS "Age",
  c_acctbal * 1e4::DOUBLE AS market_value_eur
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

cte("cs", ("dim",), """
SELECT d."Player", d."Squad", d."League", d."Pos", d."Age", d.market_value_eur, s.*
FROM (
  SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS season,
    sum(l_quantity) AS "Min",
    count_if(l_returnflag = 'R')::DOUBLE AS "Gls", count_if(l_returnflag = 'A')::DOUBLE AS "Ast",
    count(*)::DOUBLE AS "Sh", count_if(l_discount >= 0.05::DOUBLE)::DOUBLE AS "SoT",
    count_if(l_linestatus = 'O')::DOUBLE AS "Int", count_if(l_tax >= 0.04::DOUBLE)::DOUBLE AS "TklW",
    count_if(l_quantity < 10)::DOUBLE AS "Fls", count_if(l_quantity >= 40)::DOUBLE AS "Fld",
    count_if(l_linenumber >= 5)::DOUBLE AS "Crs", count_if(l_linestatus = 'F')::DOUBLE AS "Saves",
    count_if(l_returnflag = 'N')::DOUBLE AS "GA", count_if(l_extendedprice > 50000)::DOUBLE AS "SoTA",
    round(sum(l_extendedprice * l_discount) / 1e4::DOUBLE, 8) AS "xG",
    round(sum(l_extendedprice * l_tax) / 1e4::DOUBLE, 8) AS "xA"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
) s JOIN dim d ON d.c_custkey = s.o_custkey""")

cte("ru", ("cs",), f"""
SELECT "League", "Player", {', '.join(f'coalesce(sum({q(s)}), 0) AS {q(s)}' for s in SUM_STATS)},
  arg_max("Squad", season) AS "Squad", arg_max("Pos", season) AS "Pos", arg_max("Age", season) AS "Age",
  arg_max(market_value_eur, season) AS market_value_eur,
  count(DISTINCT season) = 1 AS single_season, max(season) AS last_season
FROM cs GROUP BY 1, 2""")

SAVE_RATE = '"Saves" / nullif("Saves" + "GA", 0) * 100'

cte("pl", ("ru", "cs"), f"""
SELECT ru.*, {SAVE_RATE} AS "Save%",
  {', '.join(f'{q(s)} / nullif("Min", 0) * 90 AS {q(s + "_p90")}' for s in PER90_STATS)}
FROM ru JOIN (
  SELECT "League", count(DISTINCT season) AS n, max(season) AS latest FROM cs GROUP BY 1
) l USING ("League")
WHERE coalesce("Min", 0) >= {PER_SEASON} * n AND last_season = latest""")

cte("ma", ("dim",), f"""
SELECT hr.r_name AS "League", CAST(year(o_orderdate) AS VARCHAR) AS season,
  hn.n_name AS "HomeTeam", an.n_name AS "AwayTeam",
  {_case('l_returnflag', MATCH_RESULT_OF)} AS "FTR",
  l_linenumber AS hg, CAST(l_quantity AS INT) % 6 AS ag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation hn ON hn.n_nationkey = s_nationkey
JOIN region hr ON hr.r_regionkey = hn.n_regionkey
JOIN customer ON c_custkey = o_custkey JOIN nation an ON an.n_nationkey = c_nationkey
WHERE hn.n_regionkey = an.n_regionkey AND hn.n_nationkey <> an.n_nationkey""")

cte("st", ("ma",), """
SELECT *, row_number() OVER (PARTITION BY "League", season ORDER BY "Pts" DESC, "GD" DESC, "GF" DESC, "Squad") AS "Rk"
FROM (
  SELECT *, "W" * 3 + "D" AS "Pts", "GF" - "GA" AS "GD" FROM (
    SELECT "League", season, "Squad", sum(w) AS "W", sum(d) AS "D", sum(l) AS "L", sum(gf) AS "GF", sum(ga) AS "GA"
    FROM (
      SELECT "League", season, "HomeTeam" AS "Squad", ("FTR" = 'H')::INT w, ("FTR" = 'D')::INT d, ("FTR" = 'A')::INT l, hg gf, ag ga FROM ma
      UNION ALL
      SELECT "League", season, "AwayTeam", ("FTR" = 'A')::INT, ("FTR" = 'D')::INT, ("FTR" = 'H')::INT, ag, hg FROM ma
    ) GROUP BY 1, 2, 3))""")

cte("cur", ("st",), """
SELECT st.* FROM st JOIN (SELECT "League", max(season) AS latest FROM st GROUP BY 1) m
ON st."League" = m."League" AND st.season = m.latest""")

cte("plr", ("pl", "cur"), """
SELECT pl.*, cur."Rk"::DOUBLE AS league_position
FROM pl LEFT JOIN cur ON pl."League" = cur."League" AND pl."Squad" = cur."Squad" """)

_FACTOR = "CASE WHEN league_position > h THEN 1.1::DOUBLE WHEN league_position <= h THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END"
cte("adj", ("plr",), f"""
SELECT plr.* REPLACE (
  CASE WHEN "Pos" = 'DF' THEN "Int_p90" * {_FACTOR} ELSE "Int_p90" END AS "Int_p90",
  CASE WHEN "Pos" = 'GK' THEN "Save%" * {_FACTOR} ELSE "Save%" END AS "Save%")
FROM plr LEFT JOIN (SELECT "League" AS lg, max(league_position) / 2 AS h FROM plr GROUP BY 1) ON lg = "League" """)


def _norm(s: str) -> str:
    v = f"coalesce({q(s)}, 0)"
    lo, hi = (f'{f}({v}) OVER (PARTITION BY "League", "Pos")' for f in ("min", "max"))
    users = ", ".join(f"'{p}'" for p in POSITIONS if s in stats_of(p))
    return (
        f'CASE WHEN "Pos" IN ({users}) THEN CASE WHEN {hi} > {lo} '
        f"THEN ({v} - {lo}) / nullif({hi} - {lo}, 0) ELSE 0 END END AS {q(s + '_norm')}"
    )


def _pillar(name: str) -> str:
    def one(pos: str) -> str:
        p = next(x for x in pillars_of(pos) if x.name == name)
        total = "0.0::DOUBLE" + "".join(f" + {q(s + '_norm')} * {w}::DOUBLE" for s, w in p.stats)
        return f"({total}) * {float(p.weight)}::DOUBLE"

    return f"{_for_pos(one)} AS score_{name}"


cte("nrm", ("adj",), f"""
SELECT *, {', '.join(_norm(s) for s in NORMED)} FROM adj WHERE "Pos" IN ('GK', 'FW', 'MF', 'DF')""")
cte("sco", ("nrm",), f"""
SELECT *, {' + '.join(f'score_{p}' for p in PILLARS)} AS scout_score
FROM (SELECT *, {', '.join(_pillar(p) for p in PILLARS)} FROM nrm)""")
cte("mom", ("sco",), """
SELECT "Pos", avg(scout_score) AS mx, avg(log10(market_value_eur)) AS my,
  regr_sxx(log10(market_value_eur), scout_score) AS sxx, regr_sxy(log10(market_value_eur), scout_score) AS sxy
FROM sco WHERE market_value_eur > 0 GROUP BY 1""")
cte("reg", ("sco", "mom"), """
SELECT *, pow(10, predicted_log_mv) AS predicted_mv_eur,
  log10(market_value_eur) - predicted_log_mv AS residual,
  pow(10, predicted_log_mv) - market_value_eur AS value_gap_eur
FROM (
  SELECT sco.*, my + (SELECT sum(sxy) / sum(sxx) FROM mom) * (scout_score - mx) AS predicted_log_mv
  FROM sco JOIN mom USING ("Pos") WHERE market_value_eur > 0)""")
cte("uv", ("reg",), """
SELECT *, (rank() OVER (ORDER BY -round(residual, 9)) + (count(*) OVER (PARTITION BY round(residual, 9)) - 1) / 2.0::DOUBLE)
  / count(*) OVER () * 100 AS uv_score FROM reg""")

AGE = """TRY_CAST(split_part("Age", '-', 1) AS DOUBLE)"""
MULTIPLIER = f"""CASE WHEN {AGE} IS NULL OR {AGE} >= 29 THEN 1.0::DOUBLE
  ELSE least(1.5::DOUBLE, 1.0::DOUBLE + 0.30::DOUBLE * greatest(0.0::DOUBLE, ln(greatest(29.0::DOUBLE - {AGE}, 1)) / ln(12.0::DOUBLE))) END"""
FACTOR = 'CASE "League" ' + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEAGUE_FACTOR_OF.items()) + " ELSE 1.0::DOUBLE END"

cte("mst", ("uv",), f"""
SELECT *, {FACTOR} AS league_quality_multiplier, uv_score * ({MULTIPLIER}) * ({FACTOR}) AS uv_score_age_weighted FROM uv""")

_V = [f"score_{p}" for p in PILLARS]
_LEN = "sqrt(" + " + ".join(f"{v} * {v}" for v in _V) + ")"
_DOT = " + ".join(f"a.{v} * b.{v}" for v in _V)
cte("sim", ("mst",), f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lg, player ORDER BY sim DESC, k2) AS rank FROM (
    SELECT a."League" AS lg, a."Player" AS player, b."League" AS league2, b."Player" AS player2, b."Squad" AS club2,
      b.uv_score_age_weighted AS uv2, concat(b."League", chr(1), b."Player") AS k2,
      CASE WHEN a.len = 0 OR b.len = 0 THEN 0 ELSE round(({_DOT}) / (a.len * b.len), 9) END AS sim
    FROM (SELECT *, {_LEN} AS len FROM mst) a JOIN (SELECT *, {_LEN} AS len FROM mst) b
    ON a."Pos" = b."Pos" AND (a."League" <> b."League" OR a."Player" <> b."Player")))
WHERE rank <= 5""")

_SURNAME = "translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8), '0123456789abcdef', 'bcdfghklmnaeiour')"
cte("pn", (), f"""
SELECT p_partkey, p_size, p_retailprice, p_name AS first, {_SURNAME} AS surname,
  p_name || ' ' || {_SURNAME} AS name, p_brand AS club, p_type AS "League" FROM part""")
cte("nv", ("pn",), """
SELECT name AS player_name_tm, club || ' FC' AS club_tm, p_retailprice * f AS market_value_eur, season, "League" AS league_tm
FROM pn CROSS JOIN (VALUES ('2023-24', 1000.0::DOUBLE), ('2024-25', 1500.0::DOUBLE)) y(season, f)""")
cte("mp", ("pn",), """
SELECT p_partkey AS id, CASE p_size % 5
  WHEN 0 THEN name WHEN 1 THEN first || ' ' || substr(surname, 1, 2) || substr(surname, 4, 5)
  WHEN 2 THEN surname || ' ' || upper(substr(first, 1, 1)) || substr(first, 2)
  WHEN 3 THEN first || ' de ' || surname
  ELSE first || ' ' || substr(surname, 1, 1) || 'xx' || substr(surname, 4, 3) || 'yy' END AS "Player",
  CASE WHEN p_size % 3 = 0 THEN 'Brand#0' ELSE club END AS "Squad", "League" FROM pn""")


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[\\s\\x1c-\\x1f]+', ' ', 'g'))"


def club_sql(x: str) -> str:
    out = norm_sql(x)
    for w in ("fc", "cf", "afc"):
        out = f"trim(regexp_replace({out}, '\\b{w}\\.?\\b', '', 'g'))"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def edit_sql(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE) * 100"


def score_sql(a: str, b: str) -> str:
    """Names here hold no hyphen and no 'jr', so the match text is the name itself."""
    ta, tb = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return (
        f"round(greatest({edit_sql(a, b)}, {edit_sql(sorted_sql(a), sorted_sql(b))} * 0.95::DOUBLE, "
        f"CASE WHEN list_has_all({ta}, {tb}) OR list_has_all({tb}, {ta}) THEN 90 ELSE 0 END), 6)"
    )


def _best(left: str, right: str, threshold: float, on: str = "", keys: str = "") -> str:
    """Top-1 by brute force over all pairs."""
    k = f"l.{keys}, " if keys else ""
    p = f"{keys}, norm_l" if keys else "norm_l"
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY score DESC, norm_r) AS rn FROM (
    SELECT {k}l.norm AS norm_l, r.norm AS norm_r, {score_sql('l.norm', 'r.norm')} AS score
    FROM {left} l JOIN {right} r ON {on or 'true'}) WHERE score >= {threshold})
WHERE rn = 1"""


cte("ln", ("mp",), f'SELECT DISTINCT {norm_sql(q("Player"))} AS norm FROM mp')
cte("lk", ("nv",), f"""
SELECT norm, arg_max(market_value_eur, o) AS market_value_eur, arg_max(cn, o) AS cn FROM (
  SELECT {norm_sql('player_name_tm')} AS norm, {club_sql('club_tm')} AS cn, market_value_eur,
    [season, league_tm, club_tm, player_name_tm] AS o FROM nv) GROUP BY 1""")
cte("fz", ("ln", "lk"), _best("ln", "lk", 70))
cte("xl", ("pn",), f"""
SELECT "League", norm, arg_max(xg, n) AS "xG", arg_max(xa, n) AS "xA" FROM (
  SELECT "League", name AS n, {norm_sql('name')} AS norm, sum(3.0::DOUBLE * p_size) AS xg, sum(2.0::DOUBLE * p_size) AS xa
  FROM pn GROUP BY ALL) GROUP BY 1, 2""")
cte("lx", ("mp",), f'SELECT DISTINCT "League", {norm_sql(q("Player"))} AS norm FROM mp')
cte("fx", ("lx", "xl"), _best("lx", "xl", 80, 'l."League" = r."League"', '"League"'))


def sql(body: str, *needs: str) -> str:
    """``body`` with exactly the CTEs it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order)
    return f"WITH {parts}\n{body.strip()}"


def rounded(cols, digits: int = 6) -> str:
    return ", ".join(f"round({q(x)}, {digits}) AS {q(x)}" for x in cols)
