"""Hybrid retrieval for many queries at once: filters, BM25, dense, fusion, rerank, gate, priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assistant import currency_priority, source_compatibility, source_intent
from ..functions.predicates import asked_destination
from ..functions.tokens import tokens
from ..storage import stored
from .vector_index import dense_top, pack_vectors

K1, B, RRF = 1.5, 0.75, 60
CANDIDATES, RERANKED, FLOOR, ACCEPTED, CLOSE = 200, 25, 0.20, 0.5, 1.0
#: Rows of candidates (some 60 bytes each) that are sent to all tasks.
FEW = 250_000


def filtered(chunks: DataFrame, verified_only: bool = False, code: str | None = None, authority: str | None = None, kind: str | None = None, cutoff: str | None = None, exclude_superseded: bool = False, notice: str | None = None) -> DataFrame:
    """Metadata filters, applied before ranking so that they reach the scan; a null cutoff date is out."""
    if verified_only:
        chunks = chunks.where(F.col("validation_status").isin("verified", "partially_verified"))
    if code:
        chunks = chunks.where(F.array_contains("pct_codes", code))
    if authority:
        chunks = chunks.where(F.contains(F.lower("issuing_authority"), F.lit(authority.lower())))
    if notice:
        chunks = chunks.where(F.lower(F.trim("sro_number")) == notice.strip().lower())
    if kind:
        chunks = chunks.where(F.col("document_type") == kind)
    if cutoff:
        chunks = chunks.where(F.col("legal_cutoff_date") <= F.lit(cutoff).cast("date"))
    if exclude_superseded:
        chunks = chunks.where("coalesce(currency_status, 'current') <> 'superseded'")
    return chunks


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token, tf): special tokens count like words."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score), for documents with any query token, which count with multiplicity."""
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    hit = index.join(wanted.select("token").distinct(), "token", "left_semi")
    df = hit.groupBy("token").agg(F.count("*").alias("df"))
    scored = hit.join(df, "token").join(wanted, "token").join(lengths, "doc_id").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def corpus_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, df, total): in how many documents a token is and how often, by one shuffle of partial sums per token."""
    rows = docs.select(tokens(F.col(text_col)).alias("_t"))
    one = lambda n, m: lambda t: F.struct(t.alias("token"), F.lit(n).cast("long").alias("df"), F.lit(m).cast("long").alias("total"))
    marks = rows.select(F.inline(F.concat(F.transform(F.array_distinct("_t"), one(1, 0)), F.transform("_t", one(0, 1)))))
    return marks.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _best(scores: DataFrame, score: str, limit: int, name: str) -> DataFrame:
    """The first ``limit`` per query, ranked from 1 on; ties by document."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id")
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= limit)


def fused(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of both lists; who is not in one has rank after its end."""
    joined = lexical.join(dense, ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return joined.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("lexical"), F.coalesce("dense", F.lit(0.0)).alias("dense"), F.round(part("lexical_rank") + part("dense_rank"), 6).alias("rrf"))


def overlap(query: Column, doc: Column) -> Column:
    """The share of distinct query tokens that the document has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc)) / F.size(q)).otherwise(0.0)


def _sent(rows: DataFrame) -> DataFrame:
    """Candidates, written once and sent to the documents if they are few (``FEW`` rows); if not, Spark joins them as it sees fit.

    So the texts of a corpus are scanned where they lie instead of being shuffled to a handful of rows.
    """
    kept = stored(rows)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def _once(**columns: Column) -> Column:
    """Costly columns as what a generator yields: filters and projections above refer to them and never compute them again."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _dealt(rows: DataFrame) -> DataFrame:
    """Few rows whose texts are costly to read, dealt out to all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id", "doc_id")


def reranked(candidates: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = RERANKED) -> DataFrame:
    """The first by fusion, scored by token overlap and half a point for each shared special token.

    Only the texts of these are looked at.
    """
    first = _sent(_best(candidates, "rrf", limit, "rrf_rank"))
    joined = docs.select("doc_id", F.col("text").alias("_dt")).join(first, "doc_id").join(queries.select("query_id", F.col("text").alias("_qt")), "query_id")
    split = _dealt(joined).select("query_id", "doc_id", "lexical", "dense", "rrf", _once(_q=tokens(F.col("_qt")), _d=tokens(F.col("_dt"))))
    special = F.size(F.filter(F.array_intersect("_q", "_d"), lambda t: t.rlike("^(pct|sro)[0-9]")))
    return split.select("query_id", "doc_id", "lexical", "dense", "rrf", F.round(overlap(F.col("_q"), F.col("_d")), 6).alias("overlap"), F.round(overlap(F.col("_q"), F.col("_d")) + 0.5 * special, 6).alias("rerank"))


def judged(scored: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """``scored`` (query_id, doc_id, ...) with relevance, accepted, parent_id, compatibility and currency.

    passages: doc_id, parent_id, text, title, document_type, section, kind, currency_status, pct_codes, sro_number;
    queries: query_id, text. What a question asks for (product code, destination, source family,
    the past) is read off its text; what a passage has, off its text and tags. Bonuses come only on top of real
    overlap, in which title, type and section count as text; a code in the text itself lifts it to the floor.
    """
    q, text = F.col("_question"), F.coalesce("text", F.lit(""))
    code = F.nullif(F.concat(F.regexp_extract(q, r"\b(\d{4})\.?(\d{4})\b", 1), F.regexp_extract(q, r"\b(\d{4})\.?(\d{4})\b", 2)), F.lit(""))
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("_question")).select(
        "query_id", "_question", code.alias("_code"), asked_destination(q).alias("_country"), source_intent(q).alias("_intent"), tokens(q).alias("_q"))
    rows = _dealt(passages.join(_sent(scored), "doc_id").join(asked, "query_id"))
    searchable = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("text", "title", "document_type", "section")])
    rows = rows.select("*", _once(_d=tokens(searchable), compatibility=source_compatibility(F.col("_intent"), F.col("kind"), F.col("document_type"), F.col("title")), currency=currency_priority(q, F.col("currency_status"))))
    off = lambda c: F.coalesce(c, F.lit(False))
    in_text = off(F.contains(F.regexp_replace(text, r"\D", ""), F.col("_code")))
    notice = F.col("sro_number").isNotNull() & F.exists(F.array_intersect("_q", "_d"), lambda t: t.startswith("sro"))
    rows = rows.select(*scored.columns, "parent_id", "compatibility", "currency", "pct_codes", "_code", _once(_base=overlap(F.col("_q"), F.col("_d")), _in_text=in_text, _notice=notice, _there=off(F.contains(F.lower(text), F.lower("_country")))))
    base = F.when(F.col("_in_text"), F.greatest(F.col("_base"), F.lit(FLOOR))).otherwise(F.col("_base"))
    bonus = lambda when, points: F.when(off(when), points).otherwise(0.0)
    more = (
        bonus(F.col("compatibility") >= 4, 0.25) + bonus(F.col("_in_text") | F.array_contains("pct_codes", F.col("_code")), 0.5) + bonus(F.col("_notice"), 0.5)
        + bonus(F.col("_there"), 0.25)
    )
    relevance = F.round(F.when(base < FLOOR, base).otherwise(base + more), 6)
    return rows.select(*scored.columns, "parent_id", "compatibility", "currency", relevance.alias("relevance"), (relevance >= ACCEPTED).alias("accepted"))


def one_per_parent(rows: DataFrame) -> DataFrame:
    """The best child of each parent, after the gate."""
    order = Window.partitionBy("query_id", "parent_id").orderBy(F.col("rerank").desc(), F.col("rrf").desc(), "doc_id")
    return rows.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def prioritised(rows: DataFrame, top: int = 5) -> DataFrame:
    """Those near the best by rerank first, by source and currency; the others, and ties, by rerank and fusion."""
    near = F.col("rerank") >= F.max("rerank").over(Window.partitionBy("query_id")) - CLOSE
    among = lambda c: F.when(F.col("comparable"), F.col(c)).otherwise(0).desc()
    order = Window.partitionBy("query_id").orderBy(F.col("comparable").desc(), among("compatibility"), among("currency"), F.col("rerank").desc(), F.col("rrf").desc(), "doc_id")
    return rows.withColumn("comparable", near).withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def similar_shipments(vectors: DataFrame, query: DataFrame, recent: DataFrame, k: int) -> DataFrame:
    """Top k by dot product; if any vector is of another length, the most recent instead."""
    size = len(query.first()["vector"])
    packed = vectors if "block" in vectors.columns else pack_vectors(vectors)
    return dense_top(packed, query, k) if packed.where(F.col("dim") != size).isEmpty() else recent.orderBy(F.col("updated_at").desc(), "doc_id").limit(k)


#: Words without content, and what a question's words ask of a chunk.
STOPWORDS = tuple(
    "a an the and or of to in on for from by with about is are was were be been do does did can could should would will shall may might must i me my we us our you your it its this that these those there here what which who whom whose when where why how please tell show give find list say says said any some all each every into at as if then than so such not no yes".split()
)
ASKS_TYPE = (("invoice", ("commercial_invoice",)), ("packing list", ("packing_list",)), ("form e", ("form_e", "psw_declaration")), ("certificate of origin", ("certificate_of_origin",)))
WEIGHT_SECTIONS = ("shipment_weights", "weight_totals", "package_information", "general_content", "product_line")


def shipment_gate(query: Column, document_type: Column, section: Column, text: Column) -> Column:
    """What a chunk of a shipment's documents is to a question: unavailable, conflicting, partial or verified."""
    content = lambda c: F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: ~t.isin(*STOPWORDS))
    low = F.lower(query)
    other = F.lit(False)
    for phrase, types in ASKS_TYPE:
        other = other | (F.contains(low, F.lit(phrase)) & ~document_type.isin(*types))
    return (
        F.when((F.size(content(query)) > 0) & ~F.arrays_overlap(content(query), content(text)), "shipment_evidence_unavailable").when(other, "shipment_evidence_conflicting")
        .when(F.contains(low, F.lit("weight")) & ~section.isin(*WEIGHT_SECTIONS), "shipment_evidence_partial").otherwise("shipment_evidence_verified")
    )


def shipment_top(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Of the first max(2k, 10) by fusion, the first k by rerank; ties keep the order of fusion."""
    scored = reranked(candidates, docs, queries, max(2 * k, 10))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), F.col("rrf").desc(), "doc_id")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def official_first(ranked: DataFrame) -> DataFrame:
    """Official sources before curated ones, each in the order that they came in."""
    order = Window.partitionBy("query_id").orderBy(F.col("is_official").desc(), "rank")
    return ranked.withColumn("shown", F.row_number().over(order))


def valid_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations with the first reason against them: document, notice or page not retrieved; else null.

    cited and retrieved: query_id, doc_id, notice (null if none), page (null if none).
    """
    notice = lambda c: F.regexp_replace(F.lower(c), "[^0-9ivx]", "")
    docs = retrieved.select("query_id", "doc_id", F.lit(True).alias("_doc")).distinct()
    pages = retrieved.select("query_id", "doc_id", "page", F.lit(True).alias("_page")).distinct()
    notices = retrieved.where("notice is not null").select("query_id", notice("notice").alias("_n"), F.lit(True).alias("_notice")).distinct()
    joined = cited.withColumn("_n", notice("notice")).join(docs, ["query_id", "doc_id"], "left").join(notices, ["query_id", "_n"], "left").join(pages, ["query_id", "doc_id", "page"], "left")
    reason = F.when(F.col("_doc").isNull(), "document").when(F.col("notice").isNotNull() & F.col("_notice").isNull(), "notice").when(F.col("page").isNotNull() & F.col("_page").isNull(), "page")
    return joined.select("query_id", "doc_id", "page", "notice", reason.alias("reason"))


#: What a document is called in passages, and what says that it is not needed.
DOCUMENT_TERMS = {
    "form_e": ("form-e", "form e", "export declaration"), "certificate_of_origin": ("certificate of origin",), "phytosanitary_certificate": ("phytosanitary",), "sbp_deposit_proof": ("deposit",),
    "irrevocable_letter_of_credit": ("letter of credit",), "sbp_confirmation": ("confirmation",),
}
NOT_NEEDED = r"\b(not required|no longer required|exempt|not necessary)\b"


def evidence_classes(requirements: DataFrame, passages: DataFrame) -> DataFrame:
    """Each requirement with the class of its evidence and the passage shown.

    requirements: case_id, document, has_source; passages: case_id, document, passage_id, rank, text.
    Direct if a passage names the document, conflicting if those that do disagree, else indirect; without any passage
    it rests on the configured rule, if that has a source.
    """
    names = F.coalesce(*[F.when(F.col("document") == d, F.array(*map(F.lit, ts))) for d, ts in DOCUMENT_TERMS.items()], F.array(F.replace("document", F.lit("_"), F.lit(" "))))
    low = F.lower(F.coalesce("text", F.lit("")))
    marked = passages.withColumn("_direct", F.exists(names, lambda n: F.contains(low, n))).withColumn("_no", low.rlike(NOT_NEEDED))
    best = F.min(F.struct((~F.col("_direct")).alias("far"), "rank", "passage_id"))
    found = marked.groupBy("case_id", "document").agg(best.alias("_b"), F.bool_or("_direct").alias("_direct"), F.bool_or(F.col("_direct") & F.col("_no")).alias("_no"), F.bool_or(F.col("_direct") & ~F.col("_no")).alias("_yes"))
    joined = requirements.join(found, ["case_id", "document"], "left")
    kind = F.when(F.col("_b").isNull(), F.when(F.col("has_source"), "configured_rule_only").otherwise("evidence_unavailable")).when(F.col("_no") & F.col("_yes"), "conflicting_evidence").when(F.col("_direct"), "direct_evidence").otherwise("indirect_support")
    return joined.select("case_id", "document", kind.alias("evidence_class"), F.col("_b.passage_id").alias("passage_id"))


def explanation_status(evidence: DataFrame) -> DataFrame:
    """Per check: evidence_not_found, conflicting_evidence, manual_review_required or explained.

    evidence: check_id, original_status, passage_id (null if none was found), validation_status, grounded.
    """
    some = F.col("passage_id").isNotNull()
    found = evidence.groupBy("check_id", "original_status").agg(
        F.count_if(some).alias("_n"), F.bool_or(some & (F.col("validation_status") == "conflicting")).alias("_against"), F.bool_or(some & F.col("grounded")).alias("_grounded"),
        F.bool_or(some & F.col("grounded") & (F.col("validation_status") == "verified")).alias("_verified"),
    )
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(F.col("_n") == 0, "evidence_not_found").when(off("_against"), "conflicting_evidence").when(~off("_grounded"), "manual_review_required")
        .when((F.col("original_status") == "manual_review") & ~off("_verified"), "manual_review_required").otherwise("explained")
    )
    return found.select("check_id", "original_status", status.alias("status"))


def passages_for_documents(index: DataFrame, docs: DataFrame, documents: Sequence[str], k: int = 5) -> DataFrame:
    """(document, passage_id, rank, text): the first ``k`` passages of the stored index for each kind of document, asked for by its names."""
    from .lexical_index import search

    asked = [(d, " ".join([d.replace("_", " "), *DOCUMENT_TERMS.get(d, ()), "required for export"])) for d in documents]
    found = search(index, index.sparkSession.createDataFrame(asked, "query_id string, text string"), k)
    return found.join(docs, "doc_id").select(F.col("query_id").alias("document"), F.col("doc_id").alias("passage_id"), F.col("lexical_rank").alias("rank"), "text")


def pre_submission(cases: DataFrame, rules_table: DataFrame, passages: DataFrame, no_documents: DataFrame) -> DataFrame:
    """What to prepare for an export before anything is sent: documents by rule, each with its class of evidence.

    cases: shipment_id, code, destination, shipment_date, letter_of_credit_date; the rules are run
    without documents; the two documents that any review starts from are always on the list.
    """
    from .rules import evaluate, outstanding

    listed = outstanding(evaluate(cases, no_documents, rules_table)).select(F.col("shipment_id").alias("case_id"), "document", "requirement")
    known = passages.join(listed.select("case_id", "document"), "document") if "case_id" not in passages.columns else passages
    judged = evidence_classes(listed.select("case_id", "document", F.lit(True).alias("has_source")), known).join(listed, ["case_id", "document"])
    base = cases.select(F.col("shipment_id").alias("case_id"), F.explode(F.array(F.lit("commercial_invoice"), F.lit("packing_list"))).alias("document"))
    base = base.select("case_id", "document", F.lit("required").alias("requirement"), F.lit("configured_rule_only").alias("evidence_class"))
    return base.unionByName(judged.select("case_id", "document", "requirement", "evidence_class"))
