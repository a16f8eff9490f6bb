"""Best fuzzy match per name, exactly and without comparing all pairs.

Score of two names, 0 to 100, on their match text (see ``match_text``):

* ``edit``: ``100 * (1 - levenshtein / longer length)``
* ``token sort``: the same on alphabetically sorted tokens, times 0.95
* ``containment``: 90 when the tokens of one are all among the other's

and the largest of the three counts. Candidates come from three searches that
together find every best pair at or above the threshold:

* block search: blocks of left names meet blocks of right names as arrays, and
  bounds on the letters two names share leave out most pairs (``close_names``).
* segment join (Pass-Join, Li et al., VLDB 2011), for pairs with a text of over
  ``MOST_LETTERS``: a text within K edits of another contains at least one of its
  K + 1 segments, at a bounded shift. At low thresholds the longer text of a pair
  is the one that is cut: the score then allows fewer edits than it has letters,
  so there is no lowest threshold. Both sides turn into (length, segment number,
  segment) keys for an equi-join; segments many names share are refined before
  they are joined on.
* rarest-token join: a contained name shares its rarest token with the name
  that contains it.

Names go best first: they are searched at falling thresholds and leave as soon
as their best match is settled; a name known to reach some score is searched
from that score on. Work is done on distinct names, so copies cost nothing. No
candidate is capped or dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_text, sorted_tokens
from ..session import c, cut_lineage, salted_join, ships_with_tasks, shuffled, small_side, spread
from .close_names import MOST_LETTERS, closest

ships_with_tasks(__name__)

TOKEN_SORT_WEIGHT = 0.95
CONTAINMENT_SCORE = 90.0
HEAVY_ROWS = 1_000
LEVELS = 3
BAND_ROWS = 10_000
BANDS = (90.0, 80.0)
LEFT_ROWS = 65_536  # most names of a block
RIGHT_ROWS = 65_536
LEAST_ROWS = 1_024  # a block of left names is not made smaller to give the cores more
BLOCKS_PER_CORE = 3
ONE_WAY = 67.0  # from here on K for the longest partner still leaves a text more letters than edits
_EPS = 1e-9


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(
        (1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))) * 100
    )


def token_sort_ratio(a: Column, b: Column) -> Column:
    return edit_ratio(sorted_tokens(a), sorted_tokens(b))


def contains_tokens(a: Column, b: Column) -> Column:
    x, y = F.split(a, " "), F.split(b, " ")
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def name_score(a: Column, b: Column, sorted_a: Column | None = None, sorted_b: Column | None = None) -> Column:
    """The score on two match texts; an empty text scores 0. Their sorted tokens may be given."""
    by_token = token_sort_ratio(a, b) if sorted_a is None else edit_ratio(sorted_a, sorted_b)
    best = F.greatest(
        edit_ratio(a, b),
        by_token * TOKEN_SORT_WEIGHT,
        F.when(contains_tokens(a, b), CONTAINMENT_SCORE).otherwise(0.0),
    )
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.round(best, 6))


def _names(df: DataFrame, equi: list[str], norm: str, **more: Column) -> DataFrame:
    """Each name once, with the texts it is compared by and the aggregates ``more``; stored.

    Empty names go after that: a filter before it would be computed where the names are read, in as few tasks.
    """
    keys = [*[c(e) for e in equi], c(norm).alias("norm")]
    names = df.groupBy(*keys).agg(*[x.alias(k) for k, x in more.items()]) if more else df.select(*keys).distinct()
    names = names.withColumn("text", match_text(F.col("norm"))).withColumn("_by_token", sorted_tokens(F.col("text")))
    return cut_lineage(names).where(F.col("text") != "")


def _forms(names: DataFrame, threshold: float) -> DataFrame:
    """Plain and token-sorted form of each name with the edit ratio it must reach."""
    t = threshold / 100
    plain = F.struct(F.lit(0).alias("kind"), F.col("text").alias("s"), F.lit(t).alias("t"))
    by_token = F.struct(
        F.lit(1).alias("kind"),
        F.col("_by_token").alias("s"),
        F.lit(t / TOKEN_SORT_WEIGHT).alias("t"),
    )
    forms = [plain, by_token] if t <= TOKEN_SORT_WEIGHT else [plain]
    return names.withColumn("f", F.explode(F.array(*forms))).select(
        *[x for x in names.columns if x not in ("text", "_by_token")], "f.*"
    )


def _edits(length: Column, t: Column, longest: bool) -> Column:
    """The most edits the ratio allows between a text and one no longer, or (``longest``) its longest partner."""
    reach = F.floor(length / t + _EPS) if longest else length
    return F.floor((1 - t) * reach + _EPS).cast("int")


def _cut(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of segment ``i`` of ``n`` even ones (the longer ones last)."""
    base = F.floor(length / n).cast("int")
    extra = length - base * n
    start = (i - 1) * base + F.greatest(F.lit(0), i - 1 - (n - extra)) + 1
    size = base + F.when(i > n - extra, 1).otherwise(0)
    return start.cast("int"), size.cast("int")


def _split_index(rows: DataFrame, carry: list[str]) -> DataFrame:
    """One row per segment of ``rest``; what is left of it becomes the new ``rest``.

    A rest no longer than its ``k`` edits cannot be cut: it passes on whole.
    """
    length = F.length("rest")
    can = length > F.col("k")
    n = F.when(can, F.col("k") + 1).otherwise(1)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    start, size = _cut(length, n, F.col("i"))
    rows = rows.withColumn("at", start).withColumn("size", F.when(can, size).otherwise(0))
    return _keyed(rows, carry)


def _split_probe(rows: DataFrame, carry: list[str]) -> DataFrame:
    """The substrings of ``rest`` that may equal a segment of an index rest ``len_r`` long."""
    length, n_edits = F.length("rest"), F.col("k")
    can = F.col("len_r") > n_edits
    n = F.when(can, n_edits + 1).otherwise(1)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    start, size = _cut(F.col("len_r"), n, F.col("i"))
    size = F.when(can, size).otherwise(0)
    shift, before, after = length - F.col("len_r"), F.col("i") - 1, n - F.col("i")
    low = F.greatest(F.lit(1), start - before, start + shift - after)
    high = F.least(length - size + 1, start + before, start + shift + after)
    rows = (
        rows.withColumn("lo", F.when(can, low).otherwise(1))
        .withColumn("hi", F.when(can, high).otherwise(1))
        .withColumn("size", size)
        .where("lo <= hi")
        .withColumn("at", F.explode(F.sequence("lo", "hi")))
    )
    return _keyed(rows.withColumn("len_r", F.col("len_r") - F.col("size")), [*carry, "len_r"])


def _keyed(rows: DataFrame, carry: list[str]) -> DataFrame:
    # the key is a hash: a collision is only one more pair to check
    segment = F.expr("substring(rest, at, size)")
    rest = F.expr("concat(substring(rest, 1, at - 1), substring(rest, at + size))")
    return rows.select(
        *[c(x) for x in carry], "k", F.xxhash64("key", "i", segment).alias("key"), rest.alias("rest")
    )


def _segment_candidates(
    left: DataFrame, right: DataFrame, equi: list[str], threshold: float, n_left: int, n_right: int, heavy_rows: int
) -> DataFrame:
    """Pairs within the allowed edits; at low thresholds the longer text is cut, of equally long ones the right one."""
    if threshold >= ONE_WAY:
        return _cut_pairs(left, right, equi, threshold, n_right, heavy_rows, None)
    down = _cut_pairs(left, right, equi, threshold, n_right, heavy_rows, 0)
    up = _cut_pairs(right, left, equi, threshold, n_left, heavy_rows, 1)
    swapped = up.select(*[c(e) for e in equi], F.col("norm_r").alias("norm_l"), F.col("norm_l").alias("norm_r"))
    return down.unionByName(swapped)


def _cut_pairs(
    left: DataFrame, right: DataFrame, equi: list[str], threshold: float, n_right: int, heavy_rows: int, longer: int | None
) -> DataFrame:
    """Pairs whose right text is at least ``longer`` letters longer (None: any), by equality of one of its segments.

    A segment shared by more than ``heavy_rows`` names (a common first name) is
    not joined on alone. Where it matches, the rests of both names must again be
    within the edits, so they are cut in the same way and the key is extended by
    one of their segments; what is still heavy after three levels is salted.
    """
    r = _forms(spread(right, "norm"), threshold).withColumn("len_r", F.length("s"))
    r = r.select(
        *[c(e) for e in equi], F.col("norm").alias("norm_r"), F.col("s").alias("s_r"),
        _edits(F.col("len_r"), F.col("t"), longer is None).alias("k"),
        F.xxhash64("kind", "len_r").alias("key"), F.col("s").alias("rest"),
    )
    l = _forms(spread(left, "norm"), threshold).withColumn("len_l", F.length("s"))
    l = l.withColumn("most", F.floor(F.col("len_l") / F.col("t") + _EPS).cast("int"))
    first = F.ceil(F.col("len_l") * F.col("t") - _EPS).cast("int") if longer is None else F.col("len_l") + longer
    l = l.where(F.col("most") >= first).withColumn("len_r", F.explode(F.sequence(first, "most"))).select(
        *[c(e) for e in equi], F.col("norm").alias("norm_l"), F.col("s").alias("s_l"), "t", "len_r",
        _edits(F.col("len_r"), F.col("t"), longer is None).alias("k"),
        F.xxhash64("kind", "len_r").alias("key"), F.col("s").alias("rest"),
    )

    allowed = F.floor((1 - F.col("t")) * F.greatest(F.length("s_l"), F.length("s_r")) + _EPS)
    close = F.call_function("levenshtein", F.col("s_l"), F.col("s_r"), allowed.cast("int")) >= 0
    keys, out = [*equi, "key"], [*[c(e) for e in equi], "norm_l", "norm_r"]
    carry_l, carry_r = [*equi, "norm_l", "s_l", "t"], [*equi, "norm_r", "s_r"]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.drop("k", "rest", "len_r").join(shuffled(b.drop("k", "rest")), keys)

    pairs = None
    for _ in range(LEVELS):
        l, r = _split_probe(l, carry_l), _split_index(r, carry_r)
        heavy = None
        if n_right > heavy_rows:
            heavy = small_side(
                r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows).select(*keys)
            )
        if heavy is None or heavy.isEmpty():
            found = joined(l, r).where(close).select(*out)
            return found if pairs is None else pairs.unionByName(found)
        light = joined(l, r.join(heavy, keys, "left_anti")).where(close).select(*out)
        pairs = light if pairs is None else pairs.unionByName(light)
        l, r = l.join(heavy, keys, "left_semi"), r.join(heavy, keys, "left_semi")
    rest = salted_join(l.drop("k", "rest", "len_r"), r.drop("k", "rest"), keys, close)
    return pairs.unionByName(rest.select(*out))


def _contained(small: DataFrame, large: DataFrame, equi: list[str], most: int) -> DataFrame:
    """Pairs where every token of ``small`` is among those of ``large``."""
    tokens = F.array_distinct(F.split(F.col("text"), " "))
    inside = large.select(*[c(e) for e in equi], F.col("norm").alias("norm_b"), tokens.alias("tok_b"))
    inside = inside.withColumn("tok", F.explode("tok_b"))
    seen = inside.groupBy(*[c(e) for e in equi], "tok").agg(F.count(F.lit(1)).alias("freq"))
    rare = (
        small.select(*[c(e) for e in equi], F.col("norm").alias("norm_a"), tokens.alias("tok_a"))
        .withColumn("tok", F.explode("tok_a"))
        .join(shuffled(seen), equi + ["tok"])
        .groupBy(*[c(e) for e in equi], "norm_a", "tok_a")
        .agg(F.min_by("tok", F.struct("freq", "tok")).alias("tok"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.size("tok_a"))
        .drop("found")
    )
    fits = F.size(F.array_except("tok_a", "tok_b")) == 0
    return salted_join(rare, inside, equi + ["tok"], fits, most_rows=most).select(
        *[c(e) for e in equi], "norm_a", "norm_b"
    )


def _blocks(names: DataFrame, equi: list[str], n: int, most: int) -> tuple[DataFrame | None, Column]:
    """Groups of over ``most`` names with their number of blocks (None: no groups), and the blocks of a group or of all."""
    if not equi or n <= most:
        return None, F.lit(-(-n // most))
    sizes = names.groupBy(*[c(x) for x in equi]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    return sizes, F.ceil(F.col("_n") / most).cast("int")


def _close_pairs(left: DataFrame, right: DataFrame, equi: list[str], n_left: int, n_right: int) -> DataFrame:
    """Pairs that are a left name's best by edit ratio or token sort within a block, from its bound on.

    The names of a group lie in blocks by their hash; every block of the left names meets every one of the right.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    most = min(LEFT_ROWS, max(LEAST_ROWS, n_left * -(-n_right // RIGHT_ROWS) // (BLOCKS_PER_CORE * cores)))
    e, keys = [c(x) for x in equi], [*equi, "_l", "_r"]
    sides = [x.where(F.length("text") <= MOST_LETTERS) for x in (left, right)]
    sides = [x.dropna(subset=equi) for x in sides] if equi else sides  # NULL equals nothing
    for name, n, rows in (("_lefts", n_left, most), ("_rights", n_right, RIGHT_ROWS)):
        sizes, count = _blocks(sides[name == "_rights"], equi, n, rows)
        if sizes is None:
            sides = [x.withColumn(name, count) for x in sides]
        else:
            sizes = small_side(sizes.select(*e, count.alias(name)))
            sides = [x.join(sizes, equi, "left").withColumn(name, F.coalesce(name, F.lit(1))) for x in sides]

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("norm"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # texts that equal the one before them are not sent
    forms = [F.nullif("text", "norm").alias("text"), F.nullif("_by_token", "text").alias("_by_token")]
    l = sides[0].withColumn("_l", block("_lefts")).withColumn("_r", every("_rights")).select(*keys, "norm", *forms, "_bound")
    r = sides[1].withColumn("_r", block("_rights")).withColumn("_l", every("_lefts")).select(*keys, "norm", *forms)
    # blocks are small in bytes but much work: so many partitions that few blocks share one, which adaptive execution leaves alone
    settings = left.sparkSession.conf
    n = max(cores, int(settings.get("spark.sql.shuffle.partitions")), min(4_096, 4 * -(-n_left // most) * -(-n_right // RIGHT_ROWS)))
    schema = l.select(*e, F.col("norm").alias("norm_l"), F.col("norm").alias("norm_r")).schema

    def texts(names: pa.Table) -> tuple[list[str], list[str]]:
        norm, text, by_token = (names.column(x).to_pylist() for x in ("norm", "text", "_by_token"))
        plain = [y if x is None else x for x, y in zip(text, norm, strict=True)]
        return plain, [y if x is None else x for x, y in zip(by_token, plain, strict=True)]

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        bound = mine.column("_bound").to_numpy().astype(float)
        i, j = closest(texts(mine), bound, texts(theirs), TOKEN_SORT_WEIGHT)
        i, j = pa.array(i), pa.array(j)
        found = [mine.column(x).take(i) for x in equi]
        return pa.table([*found, mine.column("norm").take(i), theirs.column("norm").take(j)], names=schema.names)

    on = [c(x) for x in keys]
    return l.repartition(n, *on).groupBy(*on).cogroup(r.repartition(n, *on).groupBy(*on)).applyInArrow(search, schema)


def _best_pairs(
    l: DataFrame, r: DataFrame, equi: list[str], threshold: float, n_l: int, n_r: int,
    heavy_rows: int, contained: bool, long: bool,
) -> DataFrame:
    """The best right name of each left name from ``threshold``, or the left name's own bound, on."""
    e = [c(x) for x in equi]
    mine = l if "_bound" in l.columns else l.withColumn("_bound", F.lit(float(threshold)))
    pairs = _close_pairs(mine, r, equi, n_l, n_r)
    l = l.drop("_bound")
    if long:
        over = F.length("text") > MOST_LETTERS
        for a, b in ((l.where(over), r), (l.where(~over), r.where(over))):
            pairs = pairs.unionByName(_segment_candidates(a, b, equi, threshold, n_l, n_r, heavy_rows))
    if contained:
        # a name has each key at most once, so its side's size bounds the rows of a key
        down = _contained(l, r, equi, n_r).select(*e, F.col("norm_a").alias("norm_l"), F.col("norm_b").alias("norm_r"))
        up = _contained(r, l, equi, n_l).select(*e, F.col("norm_b").alias("norm_l"), F.col("norm_a").alias("norm_r"))
        pairs = pairs.unionByName(down).unionByName(up)
    # as columns, so that each text is made once; only the best is compared with the threshold, else every pair would be scored twice
    texts = pairs.distinct().select(*e, "norm_l", "norm_r", match_text(F.col("norm_l")).alias("_a"), match_text(F.col("norm_r")).alias("_b"))
    texts = texts.withColumns({"_sa": sorted_tokens(F.col("_a")), "_sb": sorted_tokens(F.col("_b"))})
    return (
        texts.withColumn("score", name_score(*map(F.col, ("_a", "_b", "_sa", "_sb"))))
        .groupBy(*e, "norm_l")
        .agg(F.min_by(F.struct("norm_r", "score"), F.struct(-F.col("score"), "norm_r")).alias("b"))
        .select(*e, "norm_l", "b.norm_r", "b.score")
        .where(F.col("score") >= threshold)
    )


def _size(names: DataFrame) -> tuple[int, bool]:
    """Number of names, and whether one is too long for the block search."""
    row = names.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("m")).first()
    return row["n"], (row["m"] or 0) > MOST_LETTERS


def _none(names: DataFrame, equi: list[str]) -> DataFrame:
    """The result of a search for no names."""
    return names.where(F.lit(False)).select(
        *[c(x) for x in equi], F.col("norm").alias("norm_l"), F.col("norm").alias("norm_r"), F.lit(0.0).alias("score")
    )


def fuzzy_best(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    equi=(),
    left_norm: str = "norm",
    right_norm: str = "norm",
    known: str | None = None,
    heavy_rows: int = HEAVY_ROWS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(equi..., norm_l, norm_r, score): the best right name per left name.

    Only left names whose best score reaches ``threshold`` (above 0) appear. Equal
    scores go to the alphabetically first right name. With more than ``band_rows``
    left names the search goes down in bands, with fewer edits allowed first;
    nothing below a band can beat a match in it, so only the others go on.
    ``known`` names a column of ``left`` with a score that some right name is known
    to have: the best is no less, so such a name is searched from that score on.
    ``heavy_rows`` bounds the rows of a segment key, for names of over ``MOST_LETTERS``.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must lie above 0 and not above 100")
    equi = list(equi)
    e = [c(x) for x in equi]
    bound = {}
    if known is not None:
        bound["_bound"] = F.least(F.greatest(F.max(c(known)), F.lit(float(threshold))), F.lit(CONTAINMENT_SCORE))
    rest = _names(left, equi, left_norm, **bound)
    (n, long), nested, out = _size(rest), threshold <= CONTAINMENT_SCORE, None
    if not n:  # nothing to search for, so the right names are not cut either
        return _none(rest, equi)
    r = _names(right, equi, right_norm)
    n_r, long_r = _size(r)
    long = long or long_r
    if known is not None:
        return _best_pairs(rest, r, equi, threshold, n, n_r, heavy_rows, nested, long)
    for band in [x for x in BANDS if x > threshold]:
        if n <= band_rows:
            break
        high = cut_lineage(_best_pairs(rest, r, equi, band, n, n_r, heavy_rows, out is None and nested, long))
        out = high if out is None else out.unionByName(high)
        settled = shuffled(high.select(*e, F.col("norm_l").alias("norm")))
        rest = cut_lineage(rest.join(settled, [*equi, "norm"], "left_anti"))
        n = rest.count()
        if not n:
            return out
    found = _best_pairs(rest, r, equi, threshold, n, n_r, heavy_rows, out is None and nested, long)
    return found if out is None else out.unionByName(found)
