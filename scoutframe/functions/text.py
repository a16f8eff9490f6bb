"""Name and label text, as native column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Code points whose canonical decomposition leaves one ASCII character."""
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if not unicodedata.decomposition(ch):
            continue
        plain = unicodedata.normalize("NFD", ch).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            src.append(ch)
            dst.append(plain)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def _squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[\s\x1c-\x1f]+", " "))


def normalize_name(col: Column) -> Column:
    """Accent-free, ASCII-only, lower-case, single-spaced; NULL becomes ''.

    Letters without a decomposition (ø, ß, ł) vanish.
    """
    other = r"[^\x00-\x7F]"
    # translating is dear and changes nothing but such letters
    ascii_only = F.when(col.rlike(other), F.regexp_replace(F.translate(col, _ACCENTED, _PLAIN), other, "")).otherwise(col)
    return F.coalesce(_squeeze(F.lower(ascii_only)), F.lit(""))


def normalize_club(col: Column) -> Column:
    """Normalised name without the whole words fc, cf and afc."""
    out = normalize_name(col)
    for word in ("fc", "cf", "afc"):
        out = F.trim(F.regexp_replace(out, rf"\b{word}\.?\b", ""))
    return _squeeze(out)


def match_text(norm: Column) -> Column:
    """What the fuzzy score compares: hyphens open up and 'jr.' is spelt out."""
    return _squeeze(F.regexp_replace(F.regexp_replace(norm, "-", " "), r"\bjr\b\.?", "junior"))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.sort_array(F.split(text, " ")), " ")


def primary_position(col: Column) -> Column:
    """First entry of a comma list; NULL stays NULL (it is unscored either way)."""
    return F.trim(F.split(col, ",").getItem(0))


def xg_position(col: Column) -> Column:
    """Space-separated position tokens of the xG source to GK/FW/MF/DF."""
    tokens = F.filter(F.split(F.upper(col), r"\s+"), lambda t: t != "")
    first = F.try_element_at(tokens, F.lit(1))
    return (
        F.when(col.isNull() | (col == ""), "MF")
        .when(first.isNull() | first.isin("G", "GK"), "GK")
        .when(F.array_contains(tokens, "F"), "FW")
        .when(F.array_contains(tokens, "D"), "DF")
        .otherwise("MF")
    )


def mapped(col: Column, table: dict[str, str], default: Column) -> Column:
    """Dictionary lookup with a default, as one map literal."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), col), default)


def season_short(col: Column) -> Column:
    """'2024-25' -> '2425'."""
    parts = F.split(col, "-")
    return F.concat(F.substring(parts.getItem(0), -2, 2), F.substring(parts.getItem(1), -2, 2))


def season_long(col: Column) -> Column:
    """'2024-25' -> '2024-2025'."""
    start = F.substring_index(col, "-", 1).cast("int")
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def stat_label(col: Column) -> Column:
    """'Fld_p90' -> 'Fld/90'."""
    return F.replace(F.replace(col, F.lit("_p90"), F.lit("/90")), F.lit("_"), F.lit(" "))
