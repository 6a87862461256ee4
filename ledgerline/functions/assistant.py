"""Questions to an assistant and its answers: scope, routes, intents, claims, explanations, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import Marks

# Fixed values from here to the next function: patterns, phrases and words that results rely on.

#: Instructions aimed at the assistant itself.
GUARD = (
    r"ignore\s+(all\s+|any\s+|your\s+|the\s+)?(previous\s+|prior\s+|above\s+)?instructions?",
    r"disregard\s+(all\s+|any\s+|the\s+)?(previous\s+|prior\s+|above\s+)?(instructions?|rules?)",
    r"forget\s+(everything|all\s+previous|your\s+instructions)",
    r"you\s+are\s+now\s+",
    r"pretend\s+(you\s+are|to\s+be)",
    r"act\s+as\s+(if|a|an)\s+",
    r"system\s+prompt",
    r"jailbreak",
    r"override\s+(your|the)\s+(instructions?|rules?|settings?)",
    r"new\s+instructions?\s*:",
    r"set\s+(the\s+)?status\s+to\s+",
    r"mark\s+(this\s+)?shipment\s+(as\s+)?(approved|passed|cleared)",
)
#: Requests for what is out of scope even where words of trade are present.
OUT_OF_SCOPE = (
    r"\bwrite\b[^.?!]*\b(code|function|script|program|poem|song|story|essay|joke)\b",
    r"\b(python|javascript|typescript|java|c\+\+|golang|rust|sql query|regex)\b",
    r"\b(football|cricket|soccer|basketball|tennis|match result|score|world cup)\b",
    r"\b(movie|movies|film|films|netflix|song|lyrics|album|celebrity)\b",
    r"\b(recipe|cook|cooking|restaurant)\b",
    r"\b(repair|fix)\b[^.?!]*\b(phone|laptop|car|bike|tv|computer)\b",
    r"\b(love poem|dating|horoscope|astrology)\b",
    r"\bsort(ing)?\s+(function|algorithm|array|list)\b",
)
#: Words that admit a question alone; words of trade; words of documents, of which one each is needed.
ANCHORS = (
    "customs", "export", "import", "re-export", "tariff", "hs code", "harmonized system", "harmonised system", "pct", "psw", "pakistan single window", "single window", "tdap",
    "trade development authority", "sbp", "state bank", "form-e", "form e", "e-form", "certificate of origin", "coo", "phytosanitary", "packing list", "commercial invoice",
    "bill of lading", "airway bill", "letter of credit", "goods declaration", "customs clearance", "export policy order", "sro ", "statutory regulatory order", "incoterm",
    "duty drawback", "chamber of commerce", "consignee", "consignor", "consignment", "shipment", "shipper", "freight", "customs duty", "plant quarantine", "quarantine",
    "free trade agreement", "preferential tariff", "hs classification", "trade regulation", "regulatory corpus",
)
TRADE = (
    "ship", "shipping", "shipped", "cargo", "carton", "crate", "pallet", "container", "packed", "packing", "packaging", "abroad", "overseas", "foreign", "cross-border", "border",
    "port", "vessel", "warehouse", "bonded", "transit", "transshipment", "goods", "merchandise", "commodity", "commodities", "declared", "declare", "declaration", "origin",
    "originated", "duty", "duties", "clearance", "cleared", "exporter", "importer", "buyer", "seller", "trade", "tariff", "upload", "uploaded", "textile", "cotton", "yarn", "denim",
    "goods declaration",
)
CONCEPTS = (
    "document", "documentation", "paperwork", "form", "certificate", "certification", "invoice", "permit", "licence", "license", "approval", "declaration", "rule", "rules",
    "regulation", "regulatory", "requirement", "required", "policy", "procedure", "process", "evidence", "record", "records", "proof", "prove", "proves", "source", "sources",
    "indexed", "corpus", "clause", "law", "legal", "authority", "compliance", "compliant", "audit", "checklist", "issued", "issuing",
)
#: Claims that no grounded answer may make, with their labels.
FORBIDDEN = (
    (r"will\s+(certainly\s+|definitely\s+)?clear\s+customs", "customs-clearance claim"),
    (r"guarantee[sd]?\s+(clearance|approval|compliance)", "clearance guarantee"),
    (r"\bis\s+(fully\s+)?compliant\b", "compliance verdict"),
    (r"\bis\s+(legally\s+)?(definitely|certainly)\s+required\b", "unsupported legal claim"),
    (r"\blegally\s+required\b", "unsupported legal claim"),
    (r"this\s+shipment\s+(will|shall)\s+pass", "compliance verdict"),
    (r"\bverified\s+with\s+the\s+issuing\s+authority\b", "external-authenticity claim"),
    (r"\b(is|are)\s+authentic\b", "external-authenticity claim"),
    (r"\bcertified\s+authentic\b", "external-authenticity claim"),
    (r"\bthis\s+system\s+(approves|certifies|clears)\b", "compliance verdict"),
    (
        r"\b(these|those)\s+are\s+the\s+only\s+documents?\b|\bthe\s+only\s+documents?\s+(you\s+)?(need|needed|require[ds]?)\b|\bnothing\s+else\s+is\s+(needed|required)\b"
        r"|\bno\s+other\s+documents?\s+(are|is)\s+(needed|required)\b|\bthis\s+is\s+(a\s+)?(the\s+)?(complete|exhaustive|full)\s+list\b"
        r"|\bno\s+(extra|further|additional|other)\s+documents?\b|\bjust\s+prepare\s+these\b|\bonly\s+need\s+(these|the\s+above)\b",
        "completeness claim",
    ),
)
UNCITED = r"according to|the regulation states|the corpus states"
#: Authority that an explanation may not claim, unless a word of negation stands before in the sentence.
PROHIBITED = (
    r"\bcustoms[\s\-]?clear(?:ed|ance)\b",
    r"\bcleared\s+for\s+(?:customs|entry|export|import)\b",
    r"\bcleared\s+(?:to|for)\s+(?:proceed|enter|ship)\b",
    r"\bapproved\s+by\s+customs\b",
    r"\bofficial(?:ly)?\s+compliant\b",
    r"\bguarantee(?:d)?\s+compliant\b",
    r"\bguarantee(?:s|d)?\s+(?:entry|approval|clearance)\b",
    r"\bcan\s+proceed\s+without\s+any\s+(?:other|further|additional)\s+documents?\b",
    r"\bno\s+(?:additional|further|other)\s+documentation\s+(?:can|will|is)\s+(?:be\s+)?required\b",
    r"\bpermission\s+to\s+enter\b",
    r"\bauthoriz(?:ed|ation)\s+(?:by|from)\s+customs\b",
)
NEGATION = r"\b(?:not|never|no|isn't|is not|without|cannot|can't|does not|doesn't)\b"
#: Terms that must be explained at once, by "meaning" or "means" in the next characters.
JARGON = (
    "deterministic", "provenance", "schema", "canonical", "embeddings", "embedding", "reranking", "rerank", "retrieval", "reconciliation", "interrupt", "checkpoint", "consensus",
    "hallucination", "bm25", "reciprocal rank fusion", "cross-encoder", "cross encoder",
)
EXPLAIN_WITHIN, LEAST_WORDS = 60, 70
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
MONEY_OR_CODE = r"\$\s?\d[\d,]*(?:\.\d{1,2})?|\b\d{4}\.?\d{4}\b"
NOTICE = r"\bSRO\s+(\d{2,4}\s*\(\s*[IVXivx]+\s*\)\s*/\s*\d{4})\b"
#: Routes of a question about a shipment, in order, by phrases; one needs a phrase of each of three lists.
ROUTES = (
    ("audit_history", ("previous audit", "audit history", "past decisions", "who reviewed", "manual review history")),
    ("audit_result", ("why did it fail", "why is it rejected", "what is wrong", "missing document", "manual review", "why did it pass", "did the shipment pass", "which documents were checked", "failed")),
    ("pre_submission_guidance", ("want to export", "what documents should i prepare", "what do i need for")),
    ("regulatory_guidance", ("sro", "export policy order", "tipp", "trade agreement", "law says", "regulatory evidence", "regulatory sources")),
    ("combined_shipment_and_regulation", (("does my", "is my"), ("satisfy", "match", "required"), ("form-e", "certificate", "document"))),
    ("out_of_scope", ("change the quantity", "mark this shipment approved", "ignore previous instructions", "hide citations", "customs approved", "write a poem", "write python", "write a python", "write javascript", "write a javascript", "debug my code", "coding question")),
    ("shipment_document_fact", ("invoice total", "who is the buyer", "quantity", "match", "invoice number", "weight", "pct code", "party")),
)
#: What an intent is told by.
CODE_IN_TEXT = r"\b(\d{4})[.\s-]?(\d{4})\b"
DOCUMENT_SEARCH = r"\b(which|what|find|search|list|show)\b[^.?!]*\b(pdf|pdfs|source|sources|document|documents|file|files|passage|passages|page|pages)\b"
VERDICT = r"\b(is|are)\b[^.?!]*\b(compliant|allowed|permitted|legal|approved|cleared)\b|\bwill\b[^.?!]*\bclear\b|\bdo(es)?\s+(this|my|it)\b[^.?!]*\b(pass|comply|qualify)\b|\bcan\s+i\s+(export|ship)\b"
CHECKLIST = (
    r"\b(document|documents|paperwork|papers)\b[^.?!]*\b(need|needed|require|required|prepare|prepared|preparing|submit|arrange|obtain)\b"
    r"|\b(need|require|prepare|preparing|arrange|obtain)\b[^.?!]*\b(document|documents|paperwork|papers)\b|\b(documents?|paperwork|papers)\s+(for|when|before)\b"
    r"|\bwhat\s+(do\s+)?i\s+need\b|\bwhat\s+(things|items)\b[^.?!]*\bprepare\b[^.?!]*\bexport\b|\bchecklist\b"
)
GUIDANCE = r"\bwhat\s+documents?\b|\bwhich\s+documents?\b|\bdocuments?\s+(are\s+)?required\b|\bwhat\s+(do\s+)?i\s+need\b|\bdocuments?\s+should\s+i\s+prepare\b|\brequired\s+for\b"
EVIDENCE_LOOKUP = r"\b(which|what|whose)\b[^.?!]*\b(source|sources|document|regulation|rule|rules|sro|page)\b[^.?!]*\b(say|says|state|states|require|requires|mention|mentions|confirm|confirms|support|supports)\b"
EXPLICIT_SEARCH = r"\bfind\b|\bsearch\b|\blist (all|every|the)\b|\bevery indexed\b|\ball (indexed )?(documents|sources)\b|\bwhich (pdf|pdfs|files?)\b"
OWN_SHIPMENT = r"\bmy\s+(shipment|invoice|packing\s+list|consignment|documents?|coo|certificate|form-?e|upload(ed)?)\b|\bthis\s+shipment\b|\bthe\s+uploaded\b|\bmy\s+upload\b"
OWN_AND_RULE = r"\bsatisf|\brequir|\brule\b|\bregulation\b"
AUDIT_RESULT = r"\bdid\s+(my|this|the)\s+shipment\b|\bwhy\s+did\s+(it|my\s+shipment)\s+(pass|fail)\b|\baudit\s+(result|status|outcome)\b|\bdid\s+it\s+pass\b"
AUDIT_HISTORY = r"\baudit\s+history\b|\bprevious\s+audit\b|\bearlier\s+revision\b|\brevision\s+history\b|\bpast\s+(decisions|reviews)\b"
#: Names of documents, statuses and kinds of evidence as a reader sees them.
LABELS = {
    "form_e": "Form-E / PSW Export Declaration", "certificate_of_origin": "Certificate of Origin", "certificate_required": "Certificate of Origin", "commercial_invoice": "Commercial Invoice",
    "packing_list": "Packing List", "bill_of_lading": "Bill of Lading", "export_contract": "Export Contract", "import_permit": "Import Permit", "phytosanitary_certificate": "Phytosanitary Certificate",
    "sbp_deposit_proof": "Proof of State Bank deposit", "sbp_confirmation": "State Bank confirmation", "irrevocable_letter_of_credit": "Irrevocable Letter of Credit", "goods_declaration": "Goods Declaration",
    "product_licence": "Export Licence", "product_permit": "Export Permit", "product_certificate": "Product Certificate", "product_approval": "Export Approval", "manual_review": "Needs human confirmation",
    "not_applicable": "Does not apply to this case", "direct_evidence": "A source names this document directly", "indirect_support": "Supported by related guidance rather than a direct mention",
    "configured_rule_only": "Comes from the configured rules", "evidence_unavailable": "Not found in the current rules or sources", "conflicting_evidence": "Sources disagree; needs human confirmation",
    "evidence_not_found": "Not found in the current sources", "e_form": "e_form",
    "verified_no_licence_required_under_epo_2022_general_permission": "No separate export licence was found to be required under the matched general-permission rule.",
    "verified_no_permit_required_under_epo_2022_general_permission": "No separate export permit was found to be required under the matched general-permission rule.",
    "verified_no_approval_required_under_epo_2022_general_permission": "No separate export approval was found to be required under the matched general-permission rule.",
    "verified_conditional_destination_based": "Whether this is needed depends on the destination country and any trade scheme being used.",
    "verified_from_local_official_tariff_pdf": "Checked against the official tariff document held.",
}
VALUES = {"true": "Required", "false": "Not required under the current matched rule", "conditional": "Required only when the stated condition applies", "none": "Not stated in the current matched rule", "null": "Not stated in the current matched rule"}
VALUE_ASSIGNMENT = r"\bvalue\s*=\s*(true|false|conditional|none|null)\b"
STRUCTURE = r"\{['\"][^{}]{0,200}\}|\[\s*['\"][^\[\]]{0,200}\]"
TRAILING_KEY = r"\b(source_kind|evidence_status|validation_status|verification_status|extraction_method|rule_id|check_id|pct_codes|schema_name)\s*[:=]\s*"
SAFE = ("form_e", "e_form")
MARKER_PHRASE = r"\b(?:according to|per|from|in|see)?\s*(?:the\s+)?(?:evidence|passage|source|excerpt|document)s?\s*(?:\*\*)?\[\d+\](?:\*\*)?|\b(?:evidence|passage|source|excerpt)\s+(?:number\s+)?\d+\b"
MARKER = r"(?:\*\*)?\[\d+\](?:\*\*)?"
ORDINAL_SOURCE = r"\bthe\s+(?:first|second|third|fourth|fifth|last|above|preceding)\s+(?:indexed\s+)?(?:evidence|passage|source|excerpt|citation)s?\b"


def found(x: Column, *patterns: str) -> Column:
    """Whether one of the patterns stands in the text, in any case; false for null."""
    return F.coalesce(x.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def has(x: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(x, p))


def question(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))


def _anywhere(terms) -> list[str]:
    """Terms of several words stand anywhere."""
    return [t for t in terms if any(c in t for c in " -/")]


def _spaced(terms) -> list[str]:
    """Of single words, short ones stand alone and longer ones begin a word."""
    return [f" {t} " if len(t) <= 4 else f" {t}" for t in terms if t not in _anywhere(terms)]


#: Words without which no pattern of the list can match; a text without them is not searched for the patterns.
GUARD_WORDS = ("instruction", "disregard", "forget", "now", "pretend", "act", "system", "jailbreak", "override", "status", "shipment")
OUTSIDE_WORDS = (
    "write", "python", "javascript", "typescript", "java", "c++", "golang", "rust", "sql query", "regex", "football", "cricket", "soccer", "basketball", "tennis", "match result", "score", "world cup", "movie", "film", "netflix", "song",
    "lyrics", "album", "celebrity", "recipe", "cook", "restaurant", "repair", "fix", "love poem", "dating", "horoscope", "astrology", "sort",
)
SCOPE = Marks(anchor=_anywhere(ANCHORS), trade=_anywhere(TRADE), concept=_anywhere(CONCEPTS), guard=GUARD_WORDS, outside=OUTSIDE_WORDS)
SCOPE_SPACED = Marks(anchor=_spaced(ANCHORS), trade=_spaced(TRADE), concept=_spaced(CONCEPTS))


def scope(x: Column) -> Column:
    """struct(in_domain, reason, injection) of a question."""
    text = question(x)
    marks, spaced = SCOPE.of(text), SCOPE_SPACED.of(F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(" ")))
    stands = lambda name: SCOPE.any(marks, name) | SCOPE_SPACED.any(spaced, name)
    injection, outside = SCOPE.any(marks, "guard") & found(text, *GUARD), SCOPE.any(marks, "outside") & found(text, *OUT_OF_SCOPE)
    pair = (stands("trade") | found(text, CODE_IN_TEXT)) & stands("concept")
    reason = (
        F.when(text == "", "empty question").when(outside, "request is for content outside customs and trade scope").when(injection, "request attempts to override assistant instructions")
        .when(stands("anchor"), "matched domain anchor term").when(pair, "matched trade context and document/regulatory concept").otherwise("no customs, trade or regulatory signal found")
    )
    return F.struct((F.startswith(reason, F.lit("matched"))).alias("in_domain"), reason.alias("reason"), ((text != "") & injection).alias("injection"))


ROUTE_LISTS = {f"{name} {k}": ps for name, phrases in ROUTES for k, ps in enumerate([phrases] if isinstance(phrases[0], str) else phrases)}
ROUTED = Marks(**ROUTE_LISTS, why=("why",), required=("required",), advice=("what should i do", "how to correct"))


def route(x: Column) -> Column:
    """Where a question about a shipment goes: the first route with a phrase in it, else by how it asks."""
    marks = ROUTED.of(question(x))
    out = None
    for name, _ in ROUTES:
        hit = reduce(lambda a, b: a & b, [ROUTED.any(marks, n) for n in ROUTE_LISTS if n.rpartition(" ")[0] == name])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    why = ROUTED.any(marks, "why")
    out = out.when(why & ROUTED.any(marks, "required"), "combined_shipment_and_regulation").when(why | ROUTED.any(marks, "advice"), "audit_result")
    return out.otherwise("shipment_document_fact")


def intent(x: Column, supported: list[str], product_code: Column, candidates: Column, bare_product: Column) -> Column:
    """struct(intent, mode, code) of a question about rules, by an ordered ladder.

    product_code: the only code that the wording means, or null; candidates: how many codes it may
    mean; bare_product: whether the question names a product and nothing else.
    """
    text = F.coalesce(x, F.lit(""))
    resolved, ambiguous, named = product_code.isNotNull(), product_code.isNull() & (candidates > 1), candidates > 0
    checklist, verdict = found(text, CHECKLIST) | found(text, GUIDANCE), found(text, VERDICT)
    typed = F.nullif(F.concat(F.regexp_extract(text, CODE_IN_TEXT, 1), F.regexp_extract(text, CODE_IN_TEXT, 2)), F.lit(""))
    code = F.coalesce(typed, F.when(checklist & resolved, product_code))
    is_supported = F.coalesce(code.isin(*supported), F.lit(False))
    answer = lambda name, mode, with_code=code: F.struct(F.lit(name).alias("intent"), F.lit(mode).alias("mode"), with_code.alias("code"))
    none = F.lit(None).cast("string")
    return (
        F.when(~scope(x)["in_domain"] & ~named, answer("out_of_scope", "explanation", none))
        .when(found(text, AUDIT_HISTORY), answer("audit_history", "explanation", typed)).when(found(text, AUDIT_RESULT), answer("shipment_audit_result", "explanation", typed))
        .when(found(text, OWN_SHIPMENT) & found(text, OWN_AND_RULE), answer("combined_shipment_and_regulation", "explanation", typed)).when(found(text, OWN_SHIPMENT), answer("shipment_document_fact", "explanation", typed))
        .when(checklist & typed.isNull() & ambiguous, answer("product_clarification_required", "clarification", none))
        .when(code.isNotNull() & ~is_supported, answer("unsupported_pct_information", "explanation"))
        .when(code.isNotNull() & (checklist | verdict), answer("supported_pct_guidance", "checklist")).when(code.isNotNull(), answer("general_regulatory_information", "explanation"))
        .when(found(text, EVIDENCE_LOOKUP) & ~found(text, EXPLICIT_SEARCH), answer("regulatory_document_search", "evidence_lookup"))
        .when(found(text, EXPLICIT_SEARCH) | found(text, DOCUMENT_SEARCH), answer("regulatory_document_search", "document_search"))
        .when(bare_product & resolved & F.coalesce(product_code.isin(*supported), F.lit(False)), answer("supported_pct_guidance", "checklist", product_code))
        .when(bare_product & ambiguous, answer("product_clarification_required", "clarification", none)).otherwise(answer("general_regulatory_information", "explanation"))
    )


#: For each forbidden claim, words one of which every wording of it holds.
CLAIM_WORDS = (("customs",), ("guarantee",), ("compliant",), ("required",), ("legally",), ("shipment",), ("issuing",), ("authentic",), ("authentic",), ("system",), ("document", "nothing", "list", "prepare", "need"))
CLAIMS = Marks(**{f"claim{k}": w for k, w in enumerate(CLAIM_WORDS)}, guard=GUARD_WORDS, uncited=UNCITED.split("|"))


def violations(answer: Column, has_evidence: Column) -> Column:
    """Labels of what a grounded answer may not say, distinct and sorted, joined."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    marks = CLAIMS.of(low)
    named = [F.when(CLAIMS.any(marks, f"claim{k}") & low.rlike(p), F.lit(label)) for k, (p, label) in enumerate(FORBIDDEN)]
    named += [F.when(CLAIMS.any(marks, "guard") & found(low, *GUARD), F.lit("answer echoes an embedded instruction")), F.when(~has_evidence & CLAIMS.any(marks, "uncited"), F.lit("uncited regulatory claim"))]
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))), "|")


def prohibited_claim(x: Column) -> Column:
    """Some sentence claims an authority, with no negation before the claim."""
    claim = "|".join(f"(?:{p})" for p in PROHIBITED)
    return found(x, rf"(?:^|[.!?\n])(?:(?!{NEGATION})[^.!?\n])*?(?:{claim})")


def unexplained_jargon(x: Column) -> Column:
    within = lambda cue: EXPLAIN_WITHIN - len(cue)
    cue = rf"(?!.{{0,{within('meaning')}}}\bmeaning\b|.{{0,{within('means')}}}\bmeans\b)"
    return F.coalesce(F.lower(x).rlike("(?s)" + "|".join(f"{t}{cue}" for t in JARGON)), F.lit(False))


def ungrounded_fact(x: Column, findings: Column) -> Column:
    """An amount of money or a code whose digits the findings do not hold."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return F.exists(F.regexp_extract_all(x, F.lit(f"({MONEY_OR_CODE})"), 1), lambda t: (F.length(digits(t)) >= 2) & ~F.contains(digits(findings), digits(t)))


def ungrounded_notice(x: Column, notices: Column) -> Column:
    """A notice cited that is not among ``notices``, numbers without blanks in lower case."""
    return F.exists(F.regexp_extract_all(x, F.lit(f"(?i){NOTICE}"), 1), lambda t: ~F.array_contains(notices, F.lower(F.regexp_replace(t, r"\s+", ""))))


def explanation_failure(x: Column, status: Column, facts: Column, findings: Column, notices: Column) -> Column:
    """The first reason why an explanation may not be shown; null if it may.

    facts: values of the first item, as strings; findings: all that it may rely on, as text.
    """
    text, low = F.coalesce(x, F.lit("")), F.lower(F.coalesce(x, F.lit("")))
    digits = F.regexp_replace(text, r"\D", "")
    sections = F.contains(low, F.lit("decision")) & has(low, ("why this decision", "why the decision")) & has(low, ("what to do next", "next steps"))
    limits = F.contains(low, F.lit("official customs clearance")) & has(low, ("permission to enter", "entry into"))
    named = F.exists(facts, lambda v: F.coalesce((F.regexp_replace(v, r"\D", "") != "") & F.contains(digits, F.regexp_replace(v, r"\D", "")), F.lit(False)))
    return (
        F.when(F.trim(text) == "", "empty").when(prohibited_claim(text), "prohibited_claim").when(text.rlike(SNAKE), "raw_identifier_exposed").when(unexplained_jargon(text), "unexplained_jargon")
        .when((F.size(F.split(F.trim(text), r"\s+")) < LEAST_WORDS) | ~sections, "missing_required_structure_or_too_short").when(~limits, "missing_limitation")
        .when((status == "passed") & (F.size(facts) > 0) & ~named, "vague_passed_explanation").when(ungrounded_fact(text, findings), "ungrounded_fact").when(ungrounded_notice(text, notices), "ungrounded_citation")
    )


def shown(x: Column) -> Column:
    """Text without internal keys: known ones as a reader knows them, others as words."""
    text = F.regexp_replace(F.coalesce(x, F.lit("")), STRUCTURE, " ")
    for value, phrase in VALUES.items():
        text = F.regexp_replace(text, rf"(?i)\bvalue\s*=\s*{value}\b", phrase)
    text = F.regexp_replace(text, f"(?i){TRAILING_KEY}", "")
    names = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({SNAKE})"), 1)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    text = F.aggregate(keys, text, lambda t, k: F.replace(t, k, F.coalesce(F.try_element_at(names, k), F.replace(k, F.lit("_"), F.lit(" ")))))
    for pattern, by in ((r"[ \t]{2,}", " "), (r"\s+([,.;:])", "$1"), (r"\(\s*\)", ""), (r"\.{2,}", ".")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def has_internal_tokens(x: Column) -> Column:
    keys = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"({SNAKE})"), 1)
    return found(x, VALUE_ASSIGNMENT, TRAILING_KEY) | F.coalesce(x.rlike(STRUCTURE), F.lit(False)) | F.exists(keys, lambda k: ~k.isin(*SAFE))


def without_markers(x: Column) -> Column:
    """Prose without pointers into a numbered list that its reader never saw."""
    text = F.coalesce(x, F.lit(""))
    for pattern, by in ((f"(?i){MARKER_PHRASE}", " the indexed sources"), (MARKER, ""), (f"(?i){ORDINAL_SOURCE}", "the indexed sources"), (r"[ \t]{2,}", " "), (r" +([.,;:])", "$1")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def search_terms(x: Column) -> Column:
    """What a lexical index is asked for: words without punctuation, then dotted codes as printed."""
    text = F.coalesce(x, F.lit(""))
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: w != "")
    return F.array_join(F.concat(words, F.regexp_extract_all(text, F.lit(r"\b(\d{4}\.\d{4})\b"), 1)), " OR ")


#: Words that ask and do not tell, and what a concept is called in the sources.
STOPWORDS = tuple(
    "a an the and or of to in on for from by with about is are was were be been being do does did can could should would will shall may might must i me my mine we us our you your it its this that these those there here what which who whom whose when where why how please tell show give find search list explain describe say says said mention mentions discuss discusses talk talks any some all each every into at as if then than so such not no yes indexed corpus source sources specifically specific regarding concerning related relating broader exists exist anything something mentioned passage passages excerpt excerpts quote quotes text texts mentioning containing referencing covering discussing stating saying listing finding searching".split()
)
CONCEPT_TERMS = (
    (r"certificate of origin|\bcoo\b|country of origin|origin of the goods|where .{0,40}(originat|manufactur|produc)", "certificate of origin destination preferential tariff"),
    (r"packing list|packed inside|what is packed|carton|package contents|contents of each|inside each", "packing list supporting documents export clearance"),
    (r"form[-\s]?e\b|e-?form\b", "form-e supporting documents required export clearance"),
    (r"electronic\w*\b.{0,40}\b(declar|export|submit|file)|export declaration|goods declaration|web[-\s]?based|declared? electronic", "customs clearance procedure export web-based declaration"),
    (r"phytosanitar|plant quarantine|agricultur|plant material|plant health", "phytosanitary certificate measure"),
    (r"letter of credit|\bl/?c\b|irrevocable", "irrevocable letter of credit"),
    (r"state bank|\bsbp\b|security deposit", "state bank of pakistan security deposit"),
    (r"commercial invoice|\binvoices?\b", "commercial invoice supporting documents export clearance"),
    (r"pakistan single window|\bpsw\b", "pakistan single window customs clearance procedure export"),
    (r"\btdap\b|trade development authority", "trade development authority of pakistan"),
    (r"\b180[\s-]?days?\b|\b180[\s-]?day\b|shipment (window|deadline|period)|within \d+ days", "irrevocable letter of credit shipment 180 days raw cotton"),
    (r"\bcotton\b|\byarn\b|\bdenim\b|\btextiles?\b", "cotton textile export"),
    (r"export polic|\bsro\b|regulations?\b|prohibit|restrict", "export policy order schedule conditions"),
)


def retrieval_query(x: Column, code: Column) -> Column:
    """A question in the sources' words: its own words but stop words and codes, then concepts', then the code."""
    text = F.coalesce(x, F.lit(""))
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\b\d{4}[.\s-]?\d{4}\b", " "), F.lit(r"([a-z0-9][a-z0-9\-]*)"), 1)
    own = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    terms = [F.when(found(text, p), F.array(*map(F.lit, t.split()))).otherwise(F.array().cast("array<string>")) for p, t in CONCEPT_TERMS]
    parts = F.concat(F.when(F.size(own) > 0, own).otherwise(words), *terms, F.array_compact(F.array(code)))
    return F.array_join(F.array_distinct(parts), " ")


def compliance_query(code: Column, hint: Column, check: Column, document: Column, destination: Column, notice: Column, title: Column, asked: Column) -> Column:
    """The query for a check's evidence, of what is known of it, each part once."""
    from .predicates import joined_once

    digits = F.regexp_replace(code, r"\D", "")
    plain = F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace(check, "^xr_", ""), r"\b\d{8}\b", ""), F.lit("_"), F.lit(" ")), r"\s+", " "))
    in_title = F.nullif(F.regexp_extract(title, r"(?i)(\d{2,4}\s*\(\s*[ivx]+\s*\)\s*/\s*\d{4})", 1), F.lit(""))
    parts = [
        F.when(F.length(digits) == 8, F.concat(F.lit("PCT "), digits)), hint, plain, F.replace(document, F.lit("_"), F.lit(" ")), destination,
        F.concat(F.lit("SRO "), F.coalesce(notice, in_title)), F.nullif(F.trim(asked), F.lit("")),
    ]
    return joined_once(F.array(*parts))


#: Source families that a question names or implies.
def source_intent(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return (
        F.when(found(low, r"\b\d{4}\.?\d{4}\b") & found(low, r"\b(tariff|classification|classify|description|entry|chapter|heading)\b"), "tariff")
        .when(F.contains(low, F.lit("customs act")) | F.contains(low, F.lit("customs")) & found(low, r"\b(seizure|seize|confiscation|confiscate|powers?)\b"), "customs_act")
        .when(has(low, ("customs rules", "export facilitation scheme")) | found(low, r"\bgoods declarations?\b"), "customs_rules")
        .when(F.contains(low, F.lit("export policy order")) | found(low, r"\bappendix[- ]?[a-j]\b", r"\b(raw cotton|cotton).{0,50}\b(schedule|restriction)\b"), "export_policy")
        .when(found(low, r"\bsingle declarations?\b"), "psw_single_declaration")
        .when(found(low, r"\belectronic.{0,30}\bcertificate of origin\b", r"\bcertificate of origin.{0,30}\b(electronic|processed?)\b"), "psw_ecoo")
        .when(has(low, ("configured requirement", "configured checklist")) | found(low, r"\bdocuments? should i prepare\b"), "configured_guidance")
    )


def source_compatibility(intent_: Column, kind: Column, document_type: Column, title: Column) -> Column:
    """0 to 4: how well a passage's source fits the family that the question is after."""
    low_type, low_title = F.lower(F.coalesce(document_type, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    named = lambda t: F.contains(low_title, F.lit(t))
    curated = kind == "curated_rule_summary"
    manual = lambda t: F.when((kind == "official_manual") & named(t), 4).when(kind == "official_manual", 2).when(curated, 1).otherwise(0)
    return (
        F.when(intent_ == "tariff", F.when(kind == "official_tariff", 4).when(curated, 1).otherwise(0))
        .when(intent_ == "customs_act", F.when((low_type == "customs_act") | named("customs act"), 4).when(kind == "official_regulation", 1).otherwise(0))
        .when(intent_ == "customs_rules", F.when((low_type == "customs_rules") | named("customs rules"), 4).when(kind == "official_procedure", 2).otherwise(0))
        .when(intent_ == "export_policy", F.when(kind == "official_policy", 4).when((kind == "official_regulation") & named("export policy order"), 3).when(curated, 1).otherwise(0))
        .when(intent_ == "psw_single_declaration", manual("single declaration")).when(intent_ == "psw_ecoo", manual("electronic certificate of origin"))
        .when(intent_ == "configured_guidance", F.when(curated, 4).otherwise(1)).otherwise(0)
    )


HISTORICAL = r"\b(historical|history|previous|earlier|old|former|superseded|past)\b"


def currency_priority(x: Column, status: Column) -> Column:
    """Current sources first; for questions about the past, the old ones."""
    s = F.lower(F.coalesce(status, F.lit("current")))
    old = F.when(s == "historical_reference", 3).when(s == "superseded", 2).when(s == "current", 1).otherwise(0)
    return F.when(found(x, HISTORICAL), old).otherwise(F.when(s == "current", 3).when(s == "historical_reference", 1).otherwise(0))
