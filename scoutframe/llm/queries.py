"""The registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutframe.llm.common import crc_mod
from scoutframe.llm.conversation import damaged, repair_conversations, turns_digest
from scoutframe.llm.decontam import decontaminate
from scoutframe.llm.hard_negatives import hard_negatives
from scoutframe.llm.jaccard_join import similar_documents
from scoutframe.llm.langid import fit_profiles, identify
from scoutframe.llm.packing import pack
from scoutframe.llm.pivot_search import top_inner_products
from scoutframe.llm.quality import fit_quality, score_quality
from scoutframe.llm.simhash import near_duplicates
from scoutframe.llm.substring_dedup import substring_dedup
from scoutframe.llm.suffix_dedup import suffix_dedup
from scoutframe.llm.token_store import read_tokens, write_tokens
from scoutframe.llm.toxicity import fit_toxicity, score_toxicity
from scoutframe.session import cut_lineage, scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        _sha256(F.col("kept")).alias("kept_sha256"),
    )


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit_profiles(docs, crc_mod("doc_id", 3) != 1)
    return identify(docs, profiles).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _sha256(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return score_toxicity(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_quality(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = turns_digest(cut_lineage(repair_conversations(damaged(rows)))).withColumnRenamed("conv_id", "_id")
    every = rows.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, every["conv_id"].eqNullSafe(found["_id"]), "left").select(
        "conv_id", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", _sha256(F.lit(""))).alias("repaired_sha256"),
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_suffix_dedup, op3_pivot_search, op4_language_id, op5_decontaminate, op6_toxicity,
        op7_simhash, op8_quality, op9_substring_dedup, op10_token_store, op11_conversation_repair,
        op12_jaccard_join, op13_hard_negatives,
    )
}

ORACLES = {
    "op3_pivot_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_decontaminate": r"""
        WITH b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
        words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (
            SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
            FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE tab AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
                   lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS how
            FROM conversations, tab),
        dam AS (
            SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
                   CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy
            FROM keyed WHERE how <> 0),
        num AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
        marked AS (
            SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
            FROM num),
        stat AS (
            SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated,
                   count(*) FILTER (i > 1 AND px || x NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id),
        ins(st, pre, st2, made) AS (VALUES
            ('b', '', 'b', []::VARCHAR[]), ('s', '', 's', []), ('u', '', 'u', []), ('a', '', 'a', []),
            ('b', 'I', 'u', ['user:']), ('s', 'I', 'u', ['user:']), ('a', 'I', 'u', ['user:']), ('u', 'I', 'a', ['assistant:']),
            ('b', 'II', 'a', ['user:', 'assistant:']), ('s', 'II', 'a', ['user:', 'assistant:']),
            ('u', 'II', 'u', ['assistant:', 'user:'])),
        move(st2, x, letter, st3, c) AS (VALUES
            ('b', 's', 'K', 's', 0), ('b', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0),
            ('b', NULL, 'R', 'u', 2), ('s', NULL, 'R', 'u', 2), ('a', NULL, 'R', 'u', 2), ('u', NULL, 'R', 'a', 2),
            ('b', NULL, 'D', 'b', 3), ('s', NULL, 'D', 's', 3), ('u', NULL, 'D', 'u', 3), ('a', NULL, 'D', 'a', 3)),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, 'b' AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS made FROM stat
            UNION ALL
            SELECT conv_id, i, st, cost, audit, made FROM (
                SELECT w.conv_id, m.i, v.st3 AS st,
                       w.cost + 2 * len(n.pre) + v.c + CASE WHEN m.fault = 3 AND v.letter <> 'D' THEN 1 ELSE 0 END AS cost,
                       w.audit || n.pre || v.letter AS audit,
                       list_concat(list_concat(w.made, n.made), CASE v.letter WHEN 'D' THEN [] WHEN 'K' THEN [m.role || ':' || m.text]
                           ELSE [CASE v.st3 WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text] END) AS made
                FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
                JOIN ins n ON n.st = w.st JOIN move v ON v.st2 = n.st2 AND (v.x IS NULL OR v.x = m.x)
                WHERE m.fault NOT IN (1, 2) OR v.letter = 'D')
            QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
        goal AS (
            SELECT s.*, w.cost + 2 * len(e.pre) AS cost, w.audit || e.pre AS audit, list_concat(w.made, e.made) AS made
            FROM stat s JOIN walk w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
            JOIN ins e ON e.st = w.st AND e.st2 IN ('b', 'a')
            QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY w.cost + 2 * len(e.pre), w.audit || e.pre) = 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
               coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN goal g ON c.conv_id IS NOT DISTINCT FROM g.conv_id""",
    "op12_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id),
        link AS (
            SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
        reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
