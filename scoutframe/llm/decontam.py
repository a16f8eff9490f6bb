"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import pick
from scoutframe.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased."""
    return _words(F.translate(text, UPPER, LOWER))


def word_hashes(text: Column) -> Column:
    """A hash for each of the exact words: equal words have equal hashes, whatever stands beside them."""
    return F.transform(exact_words(text), lambda w: F.xxhash64(w))


def _winnowed(rows: DataFrame, length: int, gram: int, rest: list[str]) -> DataFrame:
    """``rows`` (wh: word hashes) with ``picked``: (place, hash) of the grams that are the smallest of a window."""
    width = length - gram + 1
    many = F.greatest(F.size("wh") - gram + 1, F.lit(0))
    grams = F.transform("wh", lambda x, i: F.xxhash64(x, *[F.get(F.col("wh"), i + j) for j in range(1, gram)]))
    rows = rows.select(*rest, "wh", F.slice(grams, F.lit(1), many).alias("g"))
    if width == 1:
        picked = F.transform("g", lambda x, i: F.struct(i.alias("p"), x.alias("h")))
        return rows.select(*rest, "wh", picked.alias("picked"))
    windows = F.greatest(F.size("g") - width + 1, F.lit(0))
    least = F.transform("g", lambda x, i: F.least(x, *[F.get(F.col("g"), i + j) for j in range(1, width)]))
    rows = rows.select(*rest, "wh", "g", F.slice(least, F.lit(1), windows).alias("m"))
    placed = F.transform(
        "g",
        lambda x, i: F.struct(
            i.alias("p"), x.alias("h"),
            F.greatest(*[F.when(i >= j, F.get(F.col("m"), F.greatest(i - j, F.lit(0)))) for j in range(width)]).alias("m"),
        ),
    )
    picked = F.transform(
        F.filter(placed, lambda s: s["h"] == s["m"]), lambda s: F.struct(s["p"].alias("p"), s["h"].alias("h"))
    )
    return rows.select(*rest, "wh", picked.alias("picked"))


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a broadcast side if it has ``most`` rows or fewer, else for a shuffle join; it must be stored."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = 10,
    gram: int = 5,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items): the words of each document inside any window of a benchmark item.

    A window is ``length`` consecutive words of an item, or a shorter item as a whole.  Of every window of a
    document or an item the smallest ``gram``-word hash is kept with its place, so two equal windows share a
    kept hash; where a document shares one with an item, the hit is extended to the windows around it, which
    are compared word by word.  ``items`` lists the ids of items found, as sorted strings.

    Words are lower-cased in A-Z only.  NULL and empty text has no words; an item without words is none; items
    with a NULL id count for hits but are not listed.  Every row of ``docs`` gives a row: rows that share an id
    (also NULL) are told apart by ``text_hash``, the XXH64 of the text.  Other columns are ignored; empty tables
    give no rows or no hits.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    who = ["doc_id", "text_hash"]
    items = pick(benchmark, item_id=item_id, text=item_text).select("item_id", exact_words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(length)))
    windows = items.select(
        "item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("w")
    )
    windows = cut_lineage(windows.select("item_id", "n", F.array_join("w", " ").alias("words")).distinct())
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``length`` of them

    def kept(df, rest):
        """``df`` with the kept grams of every window size, as arrays of (n, p, h), and those columns."""

        def sized(n):
            return lambda s: F.struct(F.lit(n).alias("n"), s["p"].alias("p"), s["h"].alias("h"))

        lists = []
        for n in sizes:
            name = f"kept{n}"
            df = _winnowed(df, n, min(gram, n), rest).select(*rest, "wh", F.transform("picked", sized(n)).alias(name))
            rest = [*rest, name]
            lists.append(name)
        return df, lists

    entries = windows.select("n", word_hashes(F.col("words")).alias("wh"))
    marks, lists = kept(entries, ["n"])
    none = F.array().cast("array<struct<n:int,p:int,h:bigint>>")
    marks = marks.select("n", F.explode(F.concat(none, *lists)).alias("k")).where("k.n = n")
    marks = cut_lineage(marks.select("n", F.col("k.h").alias("h")).distinct())

    hashed = rows.select(*who, word_hashes(F.col("text")).alias("wh"))
    hashed = hashed.select(*who, F.size("wh").alias("n_words"), "wh")
    found, lists = kept(hashed, [*who, "n_words"])
    # one entry more for each document keeps its number of words, and how often its row is there
    own = F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("p"), F.xxhash64("doc_id").alias("h")))
    found = found.select(*who, "n_words", F.explode(F.concat(own, *lists)).alias("k"))
    found = found.select(*who, "n_words", "k.n", "k.p", "k.h")
    hits = (
        found.join(_small(marks.withColumn("met", F.lit(True)), broadcast_rows), ["n", "h"], "left")
        .where("met or n = 0")
        .groupBy(*who)
        .agg(
            F.max("n_words").alias("n_words"), F.count_if(F.col("n") == 0).alias("copies"),
            F.collect_set(F.when(F.col("n") > 0, F.struct("n", "p"))).alias("places"),
        )
    )
    hits = cut_lineage(hits)

    reach = F.array_distinct(F.flatten(F.transform("places", lambda s: F.transform(
        F.sequence(F.greatest(s["p"] - (s["n"] - F.least(s["n"], F.lit(gram))), F.lit(0)), s["p"]),
        lambda i: F.struct(i.alias("start"), s["n"].alias("n")),
    ))))
    near = hits.where(F.size("places") > 0)

    def same(df: DataFrame, id_: str = "_id", hash_: str = "_hash") -> Column:
        return df["doc_id"].eqNullSafe(F.col(id_)) & (df["text_hash"] == F.col(hash_))

    # the keys of hit documents pick their texts first, so that only those texts move
    hit_keys = _small(near.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), broadcast_rows)
    texts = rows.join(hit_keys, same(rows), "left_semi")
    wanted = near.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), reach.alias("reach"))
    texts = texts.join(wanted, same(texts))
    tried = texts.select(*who, exact_words(F.col("text")).alias("w"), "reach")
    tried = tried.select(*who, F.explode(F.transform(
        F.filter("reach", lambda s: s["start"] + s["n"] <= F.size("w")),
        lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"),
                           F.array_join(F.slice("w", s["start"] + 1, s["n"]), " ").alias("words")),
    )).alias("t")).select(*who, "t.*")
    matched = tried.join(_small(windows, broadcast_rows), ["n", "words"]).groupBy(*who).agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))
    n_hit = F.aggregate("spans", nothing, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["last"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(a["last"], s["end"]).alias("last"),
    ))["n"]
    matched = matched.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), n_hit.alias("n_hit"), "items")
    out = hits.join(matched, same(hits), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        *who, F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
