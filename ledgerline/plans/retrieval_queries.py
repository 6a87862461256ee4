"""Queries over the retrieval plan: documents are chunks, benchmark items are queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import evaluation, lexical_index, retrieval, vector_index
from ..session import load
from ..storage import table_signature
from .registry import registry

QUERIES, ORACLES, query = registry()

#: What is printed after an item, by its number: questions with codes, places, sources and times in them.
ASKS = (
    "which tariff entry covers 5201.0090 raw cotton", "what powers of seizure does customs have", "what do the customs rules say of goods declarations to Germany",
    "what did the previous export policy order say under SRO 642(I)/2023", "how is a single declaration filed for 61091000 to China",
    "how is an electronic certificate of origin processed for export to Turkey", "which documents should I prepare for shipping to the United States",
)
#: What each of them asks for, as a reader would state it: source family, code, destination, whether of the past.
MEANT = (
    ("tariff", "52010090", None, False), ("customs_act", None, None, False), ("customs_rules", None, "germany", False), ("export_policy", None, None, True),
    ("psw_single_declaration", "61091000", "china", False), ("psw_ecoo", None, "turkey", False), ("configured_guidance", None, "usa", False),
)
#: What is printed after a document, by its number.
SAYS = ("PCT 5201.0090 raw cotton tariff entry", "SRO 642(I)/2023 on exports to Germany", "code 61091000 of China", "officers may seize goods", "", "declarations submitted to Turkey under customs rules", "previous order SRO 711(I)/2022")
#: What a document's source is, by the number in its name.
TITLES = ("Customs Act 1969", "Customs Rules 2001", "Export Policy Order", "Single Declaration Manual", "Electronic Certificate of Origin Manual", "Tariff")
SOURCE_KINDS = ("official_tariff", "official_regulation", "official_policy", "official_procedure", "official_manual", "curated_rule_summary", "unclassified")
STATUSES = ("current", "historical_reference", "superseded")
TAGGED = ("52010090", "52051100", "52094200", "61091000", "63023110")


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, bool) else "'" + v + "'" for v in values) + "]"


def _at(values, key: str) -> str:
    return f"({_list(values)})[{key} % {len(values)} + 1]"


def sql_tokens(x: str) -> str:
    """Tokens of a column in SQL: words with stems, product codes, notices."""
    ascii_only = rf"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
    return (
        rf"list_concat(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: CASE WHEN w IN ('confiscated', 'confiscation') THEN 'confiscate' WHEN w = 'declarations' THEN 'declaration' WHEN w = 'officers' THEN 'officer' WHEN w = 'powers' THEN 'power'"
        rf" WHEN w IN ('seized', 'seizing', 'seizure') THEN 'seize' WHEN w IN ('submission', 'submitted', 'submitting') THEN 'submit' ELSE w END), list_transform(regexp_extract_all({ascii_only}, '\b\d{{4}}\.?\d{{4}}\b'), lambda c: 'pct' || replace(c, '.', '')),"
        rf" list_transform(regexp_extract_all(lower({x}), '\d{{2,4}}\s*\(?\s*i\s*\)?\s*[/\-]?\s*\d{{4}}'), lambda n: regexp_replace(n, '^(\d{{2,4}}).*?(\d{{4}})$', 'sro\1i\2')))"
    )


DOCS_SQL = f"docs AS (SELECT doc_id, lang, coalesce(try_cast(substr(source, 4) AS INTEGER), 0) AS s, concat_ws(' ', coalesce(text, ''), {_at(SAYS, 'doc_id')}) AS text FROM documents)"
ITEMS_SQL = f"items AS (SELECT item_id AS query_id, concat_ws(' ', coalesce(text, ''), {_at(ASKS, 'item_id')}) AS text FROM benchmark)"
TEXTS = f"""
  {DOCS_SQL},
  {ITEMS_SQL}"""
BM25_OVER = f""",
  t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM docs), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL),
  dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  q AS (SELECT query_id, unnest({sql_tokens('text')}) AS token FROM items), qt AS (SELECT query_id, token, count(*) AS qtf FROM q GROUP BY ALL),
  bm AS (
    SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score
    FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), c GROUP BY ALL
  )"""
BM25 = TEXTS + BM25_OVER
DENSE = """
  e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
  de AS (SELECT query_id, doc_id, round(list_sum(list_transform(list_zip(e.v, qv.v), lambda p: p[1] * p[2])), 6) AS dense FROM e, qv)"""


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _printed(text, values, key):
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), _pick(values, key))


def _queries(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _printed(F.col("text"), ASKS, F.col("item_id")).alias("text"))


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", _printed(F.col("text"), SAYS, F.col("doc_id")).alias("text"))


def _passages(spark, sf_dir):
    """Chunks with what is known of their source; three neighbours have one parent."""
    n = F.coalesce(F.expr("try_cast(substr(source, 4) as int)"), F.lit(0))
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 3).alias("parent_id"), _printed(F.col("text"), SAYS, F.col("doc_id")).alias("text"), _pick(TITLES, n).alias("title"), F.col("lang").alias("document_type"), F.lit(None).cast("string").alias("section"),
        _pick(SOURCE_KINDS, n).alias("kind"), _pick(STATUSES, n).alias("currency_status"), F.array(_pick(TAGGED, n)).alias("pct_codes"), F.when(n % 2 == 0, "SRO 642(I)/2023").alias("sro_number"),
    )


def _index(spark, sf_dir):
    """The stored lexical index of the printed texts; written by whichever query comes first."""
    return lexical_index.index_of(_docs(spark, sf_dir), table_signature(spark, f"{sf_dir}/documents.parquet"))


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _packed(spark, sf_dir):
    return vector_index.cached_vectors(_vectors(spark, sf_dir), table_signature(spark, f"{sf_dir}/embeddings.parquet"))


def _query_vectors(spark, sf_dir):
    """An item's vector is the one of its number."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return _vectors(spark, sf_dir).join(items, "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(r"""
WITH p AS (SELECT doc_id, lower(text) AS x, regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g') AS y FROM documents), t AS (
  SELECT doc_id, unnest(list_concat(list_transform(regexp_extract_all(x, '[a-z0-9]+'), lambda w: CASE WHEN w IN ('confiscated', 'confiscation') THEN 'confiscate' WHEN w = 'declarations' THEN 'declaration' WHEN w = 'officers' THEN 'officer' WHEN w = 'powers' THEN 'power'
      WHEN w IN ('seized', 'seizing', 'seizure') THEN 'seize' WHEN w IN ('submission', 'submitted', 'submitting') THEN 'submit' ELSE w END), list_transform(regexp_extract_all(y, '\b\d{4}\.?\d{4}\b'), lambda c: 'pct' || replace(c, '.', '')),
    list_transform(regexp_extract_all(x, '\d{2,4}\s*\(?\s*i\s*\)?\s*[/\-]?\s*\d{4}'), lambda n: regexp_replace(n, '^(\d{2,4}).*?(\d{4})$', 'sro\1i\2')))) AS token FROM p), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL)
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY 1""")
def corpus_statistics(spark, sf_dir):
    return retrieval.corpus_terms(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {TEXTS}, t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM docs), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL) SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY 1")
def indexed_terms(spark, sf_dir):
    """What the stored index holds of each token; no text is read."""
    return lexical_index.terms(_index(spark, sf_dir))


@query(f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM bm) SELECT query_id, doc_id, score FROM r WHERE n <= 200")
def lexical_ranking(spark, sf_dir):
    return lexical_index.search(_index(spark, sf_dir), _queries(spark, sf_dir), retrieval.CANDIDATES).select("query_id", "doc_id", "score")


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS n FROM de) SELECT query_id, doc_id, dense, n AS dense_rank FROM r WHERE n <= 20")
def dense_ranking(spark, sf_dir):
    return vector_index.dense_top(_packed(spark, sf_dir), _query_vectors(spark, sf_dir), 20).select("query_id", "doc_id", "dense", F.col("dense_rank").cast("long").alias("dense_rank"))


FUSED = BM25 + "," + DENSE + """,
  rl AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM bm QUALIFY n <= 200),
  rd AS (SELECT query_id, doc_id, dense, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS n FROM de QUALIFY n <= 200),
  fused AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS lexical, coalesce(dense, 0.0) AS dense, round(coalesce(1.0 / (60 + rl.n), 0.0::DOUBLE) + coalesce(1.0 / (60 + rd.n), 0.0::DOUBLE), 6) AS rrf FROM rl FULL OUTER JOIN rd USING (query_id, doc_id))"""


def _fused(spark, sf_dir):
    lexical = lexical_index.search(_index(spark, sf_dir), _queries(spark, sf_dir), retrieval.CANDIDATES)
    return retrieval.fused(lexical, vector_index.dense_top(_packed(spark, sf_dir), _query_vectors(spark, sf_dir), retrieval.CANDIDATES))


@query(f"WITH {FUSED} SELECT * FROM fused")
def fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


RERANKED = FUSED + f""",
  f25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS k FROM fused QUALIFY k <= 25),
  qw AS (SELECT query_id, text AS question, list_distinct({sql_tokens('text')}) AS qw FROM items), dw AS (SELECT doc_id, lang, s, text, list_distinct({sql_tokens('text')}) AS dw FROM docs),
  rr AS (SELECT f25.query_id, f25.doc_id, lexical, dense, rrf, lang, s, text, qw, dw, round(len(list_intersect(qw, dw)) / len(qw), 6) AS overlap,
    round(len(list_intersect(qw, dw)) / len(qw) + 0.5 * len(list_filter(list_intersect(qw, dw), lambda w: regexp_matches(w, '^(pct|sro)[0-9]'))), 6) AS rerank FROM f25 JOIN qw USING (query_id) JOIN dw USING (doc_id))"""


def _reranked(spark, sf_dir):
    return retrieval.reranked(_fused(spark, sf_dir), _docs(spark, sf_dir), _queries(spark, sf_dir))


@query(f"WITH {RERANKED} SELECT query_id, doc_id, overlap, rerank FROM rr")
def reranking(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "overlap", "rerank")


GATED = RERANKED + f""",
  known AS (SELECT *, doc_id // 3 AS parent_id, {_at([m[0] for m in MEANT], 'query_id')} AS intent, {_at([m[1] for m in MEANT], 'query_id')} AS code, {_at([m[2] for m in MEANT], 'query_id')} AS country, {_at([m[3] for m in MEANT], 'query_id')} AS past,
    lower({_at(TITLES, 's')}) AS title, {_at(SOURCE_KINDS, 's')} AS kind, {_at(STATUSES, 's')} AS status, {_at(TAGGED, 's')} AS tag, s % 2 = 0 AS notice FROM rr),
  fit AS (SELECT *, CASE intent WHEN 'tariff' THEN CASE kind WHEN 'official_tariff' THEN 4 WHEN 'curated_rule_summary' THEN 1 ELSE 0 END WHEN 'customs_act' THEN CASE WHEN contains(title, 'customs act') THEN 4 WHEN kind = 'official_regulation' THEN 1 ELSE 0 END
    WHEN 'customs_rules' THEN CASE WHEN contains(title, 'customs rules') THEN 4 WHEN kind = 'official_procedure' THEN 2 ELSE 0 END WHEN 'export_policy' THEN CASE WHEN kind = 'official_policy' THEN 4 WHEN kind = 'official_regulation' AND contains(title, 'export policy order') THEN 3 WHEN kind = 'curated_rule_summary' THEN 1 ELSE 0 END
    WHEN 'psw_single_declaration' THEN CASE WHEN kind = 'official_manual' THEN CASE WHEN contains(title, 'single declaration') THEN 4 ELSE 2 END WHEN kind = 'curated_rule_summary' THEN 1 ELSE 0 END
    WHEN 'psw_ecoo' THEN CASE WHEN kind = 'official_manual' THEN CASE WHEN contains(title, 'electronic certificate of origin') THEN 4 ELSE 2 END WHEN kind = 'curated_rule_summary' THEN 1 ELSE 0 END ELSE CASE WHEN kind = 'curated_rule_summary' THEN 4 ELSE 1 END END AS compatibility,
    CASE WHEN past THEN CASE status WHEN 'historical_reference' THEN 3 WHEN 'superseded' THEN 2 ELSE 1 END ELSE CASE status WHEN 'current' THEN 3 WHEN 'historical_reference' THEN 1 ELSE 0 END END AS currency,
    coalesce(contains(regexp_replace(text, '[^0-9]', '', 'g'), code), false) AS in_text, len(list_intersect(qw, list_distinct(list_concat(dw, regexp_extract_all(title || ' ' || lang, '[a-z0-9]+'))))) / len(qw) AS base,
    notice AND len(list_filter(list_intersect(qw, dw), lambda w: starts_with(w, 'sro'))) > 0 AS same_notice FROM known),
  g AS (SELECT *, round(CASE WHEN CASE WHEN in_text THEN greatest(base, 0.2) ELSE base END < 0.2 THEN base ELSE CASE WHEN in_text THEN greatest(base, 0.2) ELSE base END + CASE WHEN compatibility >= 4 THEN 0.25 ELSE 0 END + CASE WHEN in_text OR coalesce(tag = code, false) THEN 0.5 ELSE 0 END
    + CASE WHEN same_notice THEN 0.5 ELSE 0 END + CASE WHEN coalesce(contains(lower(text), country), false) THEN 0.25 ELSE 0 END END, 6) AS relevance FROM fit)"""


def _gated(spark, sf_dir):
    return retrieval.judged(_reranked(spark, sf_dir), _passages(spark, sf_dir), _queries(spark, sf_dir))


@query(f"WITH {GATED} SELECT query_id, doc_id, relevance, relevance >= 0.5 AS accepted, compatibility, currency FROM g")
def relevance_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("query_id", "doc_id", "relevance", "accepted", "compatibility", "currency")


EVIDENCE = GATED + """, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rerank DESC, rrf DESC, doc_id) AS n FROM g WHERE relevance >= 0.5 QUALIFY n = 1),
  pr AS (SELECT *, rerank >= max(rerank) OVER (PARTITION BY query_id) - 1.0 AS comparable FROM one),
  ev AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY comparable DESC, CASE WHEN comparable THEN compatibility ELSE 0 END DESC, CASE WHEN comparable THEN currency ELSE 0 END DESC, rerank DESC, rrf DESC, doc_id) AS position FROM pr QUALIFY position <= 5)"""


def _evidence(spark, sf_dir):
    return retrieval.prioritised(retrieval.one_per_parent(_gated(spark, sf_dir).where("accepted")))


@query(f"WITH {EVIDENCE} SELECT query_id, doc_id, position FROM ev")
def evidence_search(spark, sf_dir):
    return _evidence(spark, sf_dir).select("query_id", "doc_id", F.col("position").cast("long").alias("position"))


@query(f"""
WITH {EVIDENCE}, rel AS (SELECT query_id, min(doc_id) AS doc_id FROM g WHERE doc_id % 3 = 0 AND relevance >= 0.5 GROUP BY 1), j AS (SELECT ev.query_id, position, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM ev LEFT JOIN rel USING (query_id, doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, position) AS ideal FROM j), m AS (
  SELECT query_id, max(CASE WHEN position <= 1 THEN rel ELSE 0 END) AS h1, max(CASE WHEN position <= 3 THEN rel ELSE 0 END) AS h3, max(rel) AS h5, sum(rel) / 5 AS p, coalesce(max(CASE WHEN rel = 1 THEN 1 / position END), 0) AS rr,
    sum(rel / log2(position + 1.0)) AS dcg, sum(rel / log2(ideal + 1.0)) AS best FROM i GROUP BY 1)
SELECT count(*) AS queries, round(avg(coalesce(h1, 0)), 4) AS recall_at_1, round(avg(coalesce(h3, 0)), 4) AS recall_at_3, round(avg(coalesce(h5, 0)), 4) AS recall_at_5, round(avg(coalesce(p, 0)), 4) AS precision_at_5, round(avg(coalesce(rr, 0)), 4) AS mrr,
  round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0 END), 4) AS ndcg_at_5 FROM rel LEFT JOIN m USING (query_id)""")
def retrieval_metrics(spark, sf_dir):
    relevant = _gated(spark, sf_dir).where("doc_id % 3 = 0 and accepted").groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return evaluation.retrieval_metrics(_evidence(spark, sf_dir), relevant)


@query("""SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 1 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND lang = 'en' AND doc_id % 28 > 13""")
def metadata_filters(spark, sf_dir):
    k = F.col("doc_id")
    chunks = load(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 4 == 0, "unverified").otherwise("verified").alias("validation_status"), F.array(F.when(k % 3 == 1, "61091000").otherwise("52010090")).alias("pct_codes"),
        F.when(k % 5 == 0, "Private body").otherwise("Ministry of Commerce").alias("issuing_authority"), F.col("lang").alias("document_type"),
        F.when(k % 28 > 13, F.lit("2025-01-01").cast("date")).when(k % 28 > 6, F.lit("2027-01-01").cast("date")).alias("legal_cutoff_date"), F.when(k % 7 == 0, "superseded").alias("currency_status"),
    )
    return retrieval.filtered(chunks, True, "61091000", "ministry", "en", "2026-07-22", True).select("doc_id")


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS n FROM de) SELECT query_id, doc_id, dense FROM r WHERE n <= 5")
def similar_shipments(spark, sf_dir):
    recent = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("updated_at"))
    return retrieval.similar_shipments(_packed(spark, sf_dir), _query_vectors(spark, sf_dir), recent, 5).select("query_id", "doc_id", "dense")


@query("""
WITH l AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
SELECT p.doc_id AS parent_id, c.doc_id, sha256(coalesce(p.text, c.text)) AS shown FROM l c LEFT JOIN l p ON p.doc_id = c.doc_id - 1 AND c.doc_id % 2 = 1""")
def parent_expansion(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    children = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") - 1).alias("_parent"))
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))
    joined = children.join(parents, F.col("_parent") == F.col("parent_id"), "left")
    return joined.select("parent_id", "doc_id", F.sha2(F.coalesce("parent_text", "text"), 256).alias("shown"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0)""")
def missing_vectors(spark, sf_dir):
    """Chunks without a stored vector of the model's size, which are to be embedded."""
    stored = _vectors(spark, sf_dir).where("doc_id % 4 <> 0 and size(embedding) = 64")
    return _docs(spark, sf_dir).join(stored, "doc_id", "left_anti").select("doc_id")


@query("""
SELECT lang, count(DISTINCT source) AS sources, count(*) AS chunks, max(doc_id) AS last, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents GROUP BY 1""")
def corpus_scope(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("chunks"), F.max("doc_id").alias("last"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("names"))


@query("""SELECT count(*) AS n, max(vec_id) AS latest, min(len(embedding)) AS size, bool_and(len(embedding) = 64) AS compatible FROM embeddings""")
def index_signature(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.max("vec_id").alias("latest"), F.min(F.size("embedding")).cast("long").alias("size"), F.bool_and(F.size("embedding") == 64).alias("compatible"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT doc_id, list_contains(w, 'that') AS first, list_contains(w, 'er') AS second FROM t), n AS (SELECT count(*) FILTER (WHERE first AND second) AS n FROM s)
SELECT doc_id, CASE WHEN first AND second THEN 1 ELSE 2 END AS stage FROM s, n WHERE first AND second OR n = 0 AND first""")
def two_stage_retrieval(spark, sf_dir):
    """The narrow search first; the broad one counts only if the narrow one finds nothing."""
    words = T.words(F.col("text"))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.array_contains(words, "that").alias("first"), F.array_contains(words, "er").alias("second"))
    narrow = rows.where("first and second").select("doc_id", F.lit(1).alias("stage"))
    return narrow if narrow.head(1) else rows.where("first").select("doc_id", F.lit(2).alias("stage"))


@query("""
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains(['the', 'of', 'a', 'to', 'and'], x) AND NOT regexp_matches(x, '^\\d+$'))) AS w FROM benchmark)
SELECT item_id, array_to_string(list_sort(w), ' ') AS terms FROM q""")
def query_rewrite(spark, sf_dir):
    """Codes and stop words off, the rest once each, in order."""
    words = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: ~w.isin("the", "of", "a", "to", "and") & ~w.rlike(r"^\d+$")))
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(words), " ").alias("terms"))


@query("""SELECT doc_id FROM documents WHERE coalesce(try_cast(substr(source, 4) AS INTEGER), 0) % 2 = 0""")
def notice_filter(spark, sf_dir):
    """Chunks of one notice, whatever the case and the blanks around its number."""
    return retrieval.filtered(_passages(spark, sf_dir), notice=" sro 642(i)/2023 ").select("doc_id")


@query("""SELECT vec_id AS doc_id FROM embeddings ORDER BY label DESC, vec_id LIMIT 10""")
def recency_fallback(spark, sf_dir):
    """Some stored vectors are of another model's length: the most recent instead of the nearest."""
    n = F.when(F.col("doc_id") % 50 == 7, 32).otherwise(F.size("embedding"))
    vectors = _vectors(spark, sf_dir).withColumn("embedding", F.slice("embedding", F.lit(1), n))
    recent = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("updated_at"))
    return retrieval.similar_shipments(vectors, _query_vectors(spark, sf_dir), recent, 10).select("doc_id")
