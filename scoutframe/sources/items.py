"""Nested API items and link lists flattened with native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import API_POSITIONS
from ..functions.parse import or_zero, to_number
from ..functions.text import mapped, xg_position
from ..session import c

_STAT_GROUPS = {
    "goals": ("saves", "conceded"), "shots": ("on",), "passes": ("accuracy",),
    "tackles": ("total", "blocks", "interceptions"), "duels": ("total", "won"),
    "dribbles": ("attempts", "success"), "fouls": ("drawn",),
}
API_ITEM = (
    "player struct<name:string>, statistics array<struct<team:struct<name:string>,"
    "games:struct<position:string>,"
    + ",".join(f"{g}:struct<{','.join(f'`{f}`:string' for f in fs)}>" for g, fs in _STAT_GROUPS.items())
    + ">>"
)


def flatten_api_items(df: DataFrame, text: str = "item", season: str = "season") -> DataFrame:
    """JSON items to sixteen columns: first statistics entry, 0 and MF as defaults."""
    d = df.select(F.from_json(c(text), API_ITEM).alias("i"), c(season).alias("season"))
    d = d.select(F.col("i.player.name").alias("Player"), F.try_element_at("i.statistics", F.lit(1)).alias("s"), "season")
    zero = {
        "Saves": "goals.saves", "GoalsConceded": "goals.conceded", "SoT": "shots.on",
        "Tkl": "tackles.total", "Blocks": "tackles.blocks", "Int": "tackles.interceptions",
        "DuelsTotal": "duels.total", "DuelsWon": "duels.won", "DrbAttempts": "dribbles.attempts",
        "DrbSucc": "dribbles.success", "Fld": "fouls.drawn",
    }
    position = F.coalesce(F.col("s.games.position"), F.lit(""))
    counts = {n: or_zero(F.col(f"s.{p}")).alias(n) for n, p in zero.items()}
    return d.where(F.coalesce("Player", F.lit("")) != "").select(
        "Player",
        F.coalesce("s.team.name", F.lit("")).alias("Squad"),
        mapped(position, API_POSITIONS, F.lit("MF")).alias("Pos"),
        counts["Saves"], counts["GoalsConceded"], counts["SoT"],
        to_number(F.replace(F.col("s.passes.accuracy"), F.lit("%"), F.lit(""))).alias("Cmp%"),
        *[counts[n] for n in ("Tkl", "Blocks", "Int", "DuelsTotal", "DuelsWon", "DrbAttempts", "DrbSucc", "Fld")],
        "season",
    )


def flatten_xg_items(df: DataFrame, season: str, wide: bool = False) -> DataFrame:
    """xG items (text fields) to typed rows; missing or empty becomes '' or 0.0."""

    def num(field: str, name: str):
        return (or_zero(c(field)) if field in df.columns else F.lit(0.0)).alias(name)

    def text(field: str, name: str):
        return (F.coalesce(c(field), F.lit("")) if field in df.columns else F.lit("")).alias(name)

    cols = [
        text("player_name", "Player"), text("team_title", "Squad"),
        xg_position(c("position")).alias("Pos"), num("time", "Min"),
    ]
    if wide:
        cols += [num("goals", "Gls"), num("assists", "Ast")]
    cols += [num("xG", "xG"), num("xA", "xA")]
    if wide:
        cols += [num("npxG", "npxG"), num("xGChain", "xGChain"), num("xGBuildup", "xGBuildup"),
                 num("shots", "Sh"), num("key_passes", "KP")]
    return df.select(*cols, F.lit(season).alias("season"))


def page_links(
    pages: DataFrame, page: str = "page_id", html: str = "html", marker: str = "/verein/",
) -> DataFrame:
    """Anchors whose target holds ``marker``: slug, id and text, first per page and id.

    The id is the path part behind the marker, the slug the first path part of
    the target. Deduplication is an aggregation on (page, id).
    """
    anchor = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    found = pages.select(
        c(page),
        F.posexplode(F.regexp_extract_all(c(html), F.lit(anchor), F.lit(0))).alias("at", "a"),
    )
    href = F.regexp_extract("a", anchor, 1)
    label = F.trim(F.regexp_replace(F.regexp_extract("a", anchor, 2), r"(?s)<[^>]*>", ""))
    parts = F.split(F.col("href"), F.lit(f"\\Q{marker}\\E"))
    # a second marker inside the target is not a club link
    links = found.select(c(page), "at", href.alias("href"), label.alias("name")).where(F.size(parts) == 2)
    links = links.select(
        c(page), "at", "name",
        F.substring_index(parts.getItem(1), "/", 1).alias("id"),
        F.substring_index(F.regexp_replace("href", "^/+", ""), "/", 1).alias("slug"),
    ).where(F.col("id") != "")
    return (
        links.groupBy(c(page), "id")
        .agg(F.min_by(F.struct("slug", "name", "at"), "at").alias("l"))
        .select(c(page), "id", "l.slug", "l.name", "l.at")
    )
