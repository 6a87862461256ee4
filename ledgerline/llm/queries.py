"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, media, mixing, packing, page_text, pieces, quality, repeats, toxicity, trie, url_filter, whitening
from .common import table

#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
    return found.withColumn("repeated", found["n_removed"] > 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontamination.digest(found)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    return packing.shard(docs, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "item")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row", "source_id")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_text(table(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = media.media_columns(table(spark, sf_dir, "documents"))
    clip = F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string")))
    return found.select(*[c for c in found.columns if c != "clips"], F.size("clips").alias("n_clips"), F.array_join(clip, ";").alias("clips_ms"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The prefix tree of conversations that begin like the first of their hundred."""
    from pyspark.sql import functions as F

    conv = F.col("conv_id")
    opening = F.crc32(conv.cast("string").cast("binary")) % 6
    seq, convs = trie.with_shared_openings(trie.stored(trie.turns(conversations)), conv - conv % 100, opening, 5)
    return trie.prefix_trie(seq, convs)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_nodes(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return pieces.digest(pieces.encode_pieces(table(spark, sf_dir, "documents"), model))


QUERIES = {f.__name__: f for f in (
    op1_repeats, op2_decontamination, op3_quality, op4_url_filter, op5_vector_packing,
    op6_source_mix, op7_page_text, op8_media, op9_jaccard_join, op10_toxicity, op11_conversation_trie, op12_whitening, op13_sentencepiece,
)}

ORACLE_SQL = {
    "op4_url_filter": """
        WITH parts AS (
          SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
        ), urls AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM parts
        ), ruled AS (
          SELECT *, CASE
            WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
          FROM urls
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op11_conversation_trie": """
        WITH bits AS (  -- of each id's digits, the lowest bit of a digit first
          SELECT conv_id, list((ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 AS INT) + 1, 1)) >> CAST(i % 8 AS INT)) & 1 ORDER BY i) AS bits
          FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), range(8 * length(CAST(conv_id AS VARCHAR))) AS r(i)
          GROUP BY conv_id
        ), convs AS (
          SELECT conv_id, conv_id - conv_id % 100 AS base,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda a, b: xor(a >> 1, 3988292384 * xor(a & 1, b))), 4294967295::BIGINT) % 6 AS h
          FROM bits
        ), own AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
          FROM conversations WHERE conv_id IS NOT NULL
        ), pieces AS (
          SELECT c.conv_id, 0 AS part, o.p, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.p <= c.h
          UNION ALL
          SELECT c.conv_id, 1, o.p, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.p > c.h
        ), turns AS (
          SELECT conv_id, length(text) AS chars, sha256(length(role) || ':' || role || ':' || text) AS key,
                 row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d
          FROM pieces
        ), member AS (
          SELECT conv_id, d, chars, sha256(string_agg(key, '/') OVER (PARTITION BY conv_id ORDER BY d)) AS path,
                 count(*) OVER (PARTITION BY conv_id) AS last
          FROM turns
          UNION ALL
          SELECT c.conv_id, 0, 0, 'root', (SELECT count(*) FROM turns t WHERE t.conv_id = c.conv_id) FROM convs c
        ), node AS (
          SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = last), '')) AS ends_sha256
          FROM member GROUP BY d, path
        ), linked AS (  -- each node with the path of the node above, read off its least member
          SELECT n.*, m.path AS up, u.conv_id AS parent_conv_id
          FROM node n LEFT JOIN member m ON m.conv_id = n.conv_id AND m.d = n.d - 1
               LEFT JOIN node u ON u.d = m.d AND u.path = m.path
        ), children AS (
          SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL
        ), complete AS (
          SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (d, path)
        ), below AS (
          SELECT m.d, m.path, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n - 1) * x.chars) AS saved
          FROM complete x JOIN member m ON m.conv_id = x.conv_id AND m.d <= x.d GROUP BY m.d, m.path
        )
        SELECT conv_id, d AS depth, parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
        FROM complete JOIN below USING (d, path)
    """,
}
