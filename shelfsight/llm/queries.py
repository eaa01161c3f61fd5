"""The operators over their whole tables, by name, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import alignment, chat, language, licences, lines, mixing, near_duplicates, negatives, neighbours, packing, private, quality, topk
from shelfsight.llm.common import table


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of near duplicates."""
    classes = near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "stays")


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document."""
    found = private.personal_data(table(spark, sf_dir, "documents"))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return found.select("doc_id", *[F.col(f"found.{n}").alias(n) for n in names])


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer products of every fiftieth vector."""
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five near vectors, by cosine, of every fiftieth vector."""
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows of each conversation hold, read back from them."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.chat_windows(told.unionByName(more)))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of each document."""
    return licences.scanned(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, its source taken as its host."""
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs, F.col("text"), F.col("lang"), F.col("source"))
    return found.select("doc_id", "language", "confidence", "accepted")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each page from its text, markup, address suffix and host."""
    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    said = F.nullif(F.regexp_extract("html", r'(?i)<html\b[^>]*?\blang="?([A-Za-z]+)', 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    found = language.identified(pages, text, said, host)
    return found.select("page_id", "language", "confidence", "accepted")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document; labels of a fifth of the ids are held out."""
    docs = table(spark, sf_dir, "documents")
    # No label belongs to a row without an id.
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 5) == 0, F.lit(True))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    found = quality.scored(docs, quality.trained(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources, weighted 1, 2, 3 in turn, takes of each document."""
    taken = mixing.Mix(table(spark, sf_dir, "documents")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives of each positive of every fiftieth vector; each seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of each document and its lines that too many documents of its source share."""
    found = lines.line_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False)
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed", "left_words",
    ]
    return found.select("doc_id", *[F.col(f"rules.{n}").alias(n) for n in names])


def tokenizer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies meet in each document."""
    return alignment.link_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_order_minhash": near_dedup,
    "op2_personal_data": pii,
    "op3_norm_buckets": exact_search,
    "op4_multi_index": near_search,
    "op5_chat_windows": chat_format,
    "op6_license_scan": license_scan,
    "op7_language_id": language_id,
    "op8_quality_ranking": quality_scores,
    "op9_bm25_packing": pack,
    "op10_source_schedule": mix,
    "op11_packed_negatives": hard_negatives,
    "op12_line_frequency": line_frequency,
    "op13_identity_alignment": tokenizer_links,
    "language_pages": language_of_pages,
}

TWINS = {
    "op3_norm_buckets": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_packed_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike
            WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op12_line_frequency": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), l AS (
            SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
                   regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS plain
            FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ), hosts AS (
            SELECT source, count(*) AS held FROM d GROUP BY source
        ), frequent AS (
            SELECT f.source, f.plain
            FROM (SELECT source, plain, count(DISTINCT r) AS found FROM l GROUP BY source, plain) f
            JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
            WHERE found > 10 AND found > floor(held * 0.001)
        ), gone AS (
            SELECT l.r, sum(words) AS words, count(*) AS removed
            FROM l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.plain = f.plain
            GROUP BY l.r
        ), dup AS (
            SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r
        ), runs AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times
            FROM (SELECT r, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c,
                         generate_subscripts(w[3:], 1) AS i FROM d WHERE len(w) > 2)
        ), again AS (
            SELECT r, count(DISTINCT p) AS n
            FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE times > 1) GROUP BY r
        ), m AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
                   CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(len(w) - coalesce(gone.words, 0) AS BIGINT) AS left_words
            FROM d LEFT JOIN dup USING (r) LEFT JOIN again USING (r) LEFT JOIN gone USING (r)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
               AND (removed = 0 OR (left_words >= 50 AND 100 * left_words >= 50 * n_words)) AS kept
        FROM m
    """,
}
