"""Fixed values of the valuation model (data, not logic)."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: positions, pillars, weights, labels ------------------------
POSITIONS = ("GK", "FW", "MF", "DF")
PILLARS = ("attacking", "progression", "creation", "defense", "retention")


@dataclass(frozen=True)
class Pillar:
    pos: str
    name: str
    weight: float
    label: str
    stats: tuple[tuple[str, float], ...]


PILLAR_MODEL: tuple[Pillar, ...] = (
    Pillar("FW", "attacking", 45, "Attacking",
           (("xG_p90", 0.45), ("SoT_p90", 0.35), ("Ast_p90", 0.20))),
    Pillar("FW", "progression", 20, "Progression",
           (("Sh_p90", 0.65), ("Fld_p90", 0.35))),
    Pillar("FW", "creation", 20, "Creation",
           (("xA_p90", 0.50), ("Ast_p90", 0.30), ("Crs_p90", 0.20))),
    Pillar("FW", "defense", 5, "Defense",
           (("Int_p90", 0.55), ("TklW_p90", 0.45))),
    Pillar("FW", "retention", 10, "Retention", (("Fld_p90", 1.00),)),
    Pillar("MF", "attacking", 20, "Attacking",
           (("xG_p90", 0.40), ("Gls_p90", 0.35), ("SoT_p90", 0.25))),
    Pillar("MF", "progression", 30, "Progression",
           (("Crs_p90", 0.55), ("Fld_p90", 0.45))),
    Pillar("MF", "creation", 25, "Creation",
           (("xA_p90", 0.50), ("Ast_p90", 0.30), ("Crs_p90", 0.20))),
    Pillar("MF", "defense", 15, "Defense",
           (("Int_p90", 0.55), ("TklW_p90", 0.45))),
    Pillar("MF", "retention", 10, "Retention", (("Fld_p90", 1.00),)),
    Pillar("DF", "attacking", 10, "Attacking",
           (("Gls_p90", 0.40), ("Ast_p90", 0.35), ("SoT_p90", 0.25))),
    Pillar("DF", "progression", 15, "Progression", (("Crs_p90", 1.00),)),
    Pillar("DF", "creation", 10, "Creation",
           (("Ast_p90", 0.60), ("Crs_p90", 0.40))),
    Pillar("DF", "defense", 45, "Defense",
           (("Int_p90", 0.55), ("TklW_p90", 0.45))),
    Pillar("DF", "retention", 20, "Retention", (("Fld_p90", 1.00),)),
    Pillar("GK", "attacking", 70, "Shot Stopping", (("Save%", 1.00),)),
    Pillar("GK", "progression", 20, "Workload", (("Saves_p90", 1.00),)),
    Pillar("GK", "creation", 5, "Aerial Command", (("Int_p90", 1.00),)),
    Pillar("GK", "defense", 3, "Sweeping", (("TklW_p90", 1.00),)),
    Pillar("GK", "retention", 2, "Composure", (("Fld_p90", 1.00),)),
)

# --- fixed values: aggregation -------------------------------------------------
SUM_STATS = (
    "Min", "Gls", "Ast", "Sh", "SoT", "Int", "TklW", "Fls", "Fld", "Crs",
    "Saves", "GA", "SoTA", "xG", "xA",
)
PER90_STATS = (
    "Gls", "Ast", "Sh", "SoT", "Int", "TklW", "Fls", "Fld", "Crs", "Saves", "xG", "xA",
)

# --- fixed values: thresholds and factors -------------------------------------
SEASONS = ("2023-24", "2024-25")
MIN_MINUTES_PER_SEASON = 900
FUZZY_THRESHOLD = 80.0
FUZZY_THRESHOLD_CLUB = 70.0
TOKEN_SORT_GATE = 60.0
MATCH_RATE_WARNING = 0.70
STRENGTH_STEP = 0.10
STRENGTH_STATS = {
    "DF": ("Tkl_p90", "Int_p90", "Blocks_p90"),
    "GK": ("Save%", "PSxG/SoT"),
}
LEAGUE_FACTORS = {
    "EPL": 1.10, "LaLiga": 1.08, "Bundesliga": 1.05, "SerieA": 1.03, "Ligue1": 1.00,
}
NEIGHBOURS = 5

# --- fixed values: per-table column rules for the star join ---------------------
STAT_TABLES = (
    "stats_standard", "stats_shooting", "stats_passing", "stats_defense",
    "stats_possession", "stats_misc", "stats_gca", "stats_keeper", "stats_keeper_adv",
)
JOIN_KEYS = ("Player", "Squad", "Pos", "Age")
TABLE_DROPS = {
    "stats_standard": ("PrgC", "PrgP"),
    "stats_shooting": ("Gls", "xG", "Rk", "Nation", "Comp", "Matches"),
    "stats_passing": ("xAG", "Rk", "Nation", "Comp", "Matches", "Ast"),
    "stats_defense": ("Tkl.1", "Succ", "Rk", "Nation", "Comp", "Matches"),
    "stats_possession": ("Rk", "Nation", "Comp", "Matches"),
    "stats_misc": ("Rk", "Nation", "Comp", "Matches", "Won%"),
    "stats_gca": ("SCA90", "GCA", "GCA90", "Rk", "Nation", "Comp", "Matches"),
    "stats_keeper": ("MP", "Starts", "Min", "90s", "GA90", "CS%", "Rk", "Nation", "Comp",
                     "Matches", "W", "D", "L"),
    "stats_keeper_adv": ("GA", "Rk", "Nation", "Comp", "Matches", "Cmp%", "PSxG+/-", "/90"),
}
TABLE_DROP_SUFFIXES = {
    "stats_standard": (".1", ".2"),
    "stats_shooting": (".1", ".2"),
    "stats_passing": (".1", ".2", ".3"),
    "stats_defense": (".1", ".2"),
    "stats_gca": (".1",),
    "stats_keeper_adv": (".1", ".2"),
}
TABLE_RENAMES = {
    "stats_possession": {"Att": "Att_drb"},
    "stats_misc": {"Won": "AerWon", "Lost": "AerLost"},
}

# --- fixed values: results-feed team names -> canonical names -------------------
TEAM_NAMES = {
    "Man United": "Manchester Utd",
    "Man City": "Manchester City",
    "Leeds": "Leeds United",
    "Leicester": "Leicester City",
    "Wolves": "Wolverhampton Wanderers",
    "Newcastle": "Newcastle Utd",
    "Nottingham Forest": "Nott'ham Forest",
    "Norwich": "Norwich City",
    "Ath Bilbao": "Athletic Club",
    "Ath Madrid": "Atlético Madrid",
    "Betis": "Real Betis",
    "La Coruna": "Deportivo de La Coruña",
    "Espanol": "Espanyol",
    "Sociedad": "Real Sociedad",
    "Vallecano": "Rayo Vallecano",
    "Greuther Furth": "Greuther Fürth",
    "Leverkusen": "Bayer Leverkusen",
    "Ein Frankfurt": "Eintracht Frankfurt",
    "Hertha": "Hertha BSC",
    "Koln": "Köln",
    "Fortuna Dusseldorf": "Fortuna Düsseldorf",
    "Nurnberg": "Nürnberg",
    "Paderborn": "Paderborn 07",
    "Dusseldorf": "Fortuna Düsseldorf",
    "Inter": "Internazionale",
    "Verona": "Hellas Verona",
    "Paris SG": "Paris S-G",
    "St Etienne": "Saint-Étienne",
}
API_POSITIONS = {"Goalkeeper": "GK", "Defender": "DF", "Midfielder": "MF", "Attacker": "FW"}

# --- fixed values: serving defaults --------------------------------------------
AGE_RANGE = (17, 38)
VALUE_RANGE_M = (0, 200)


def pillars_of(pos: str) -> tuple[Pillar, ...]:
    return tuple(p for p in PILLAR_MODEL if p.pos == pos)


def stats_of(pos: str) -> tuple[str, ...]:
    """Distinct stats a position is scored on, in pillar order."""
    return tuple(dict.fromkeys(s for p in pillars_of(pos) for s, _ in p.stats))
