"""Predicates and classifiers over texts: safety, claims, sources, routes, destinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import phrase_numbers

#: Phrases that try to steer whoever reads the text.
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions", r"disregard\s+(the\s+)?(above|previous|prior)", r"mark\s+(this\s+)?(shipment|it)\s+(as\s+)?compliant",
    r"\bmark\s+.*\b(passed|compliant)\b", r"change\s+the\s+pct\s+code", r"reveal\s+the\s+system\s+prompt", r"skip\s+(the\s+)?human\s+review", r"you\s+are\s+now\s+",
    r"call\s+(another\s+)?tool", r"override\s+the\s+(compliance|deterministic)",
)
#: Canonical destinations and how they are written.
DESTINATIONS = {
    "USA": ("usa", "u s a", "us", "u s", "united states", "united states of america", "america", "the united states", "stateside"),
    "China": ("china", "prc", "peoples republic of china", "mainland china"),
    "Afghanistan": ("afghanistan", "kabul"), "United Kingdom": ("uk", "u k", "united kingdom", "britain", "great britain", "england"),
    "Germany": ("germany", "deutschland"), "European Union": ("eu", "european union", "europe"), "Bangladesh": ("bangladesh",), "Turkey": ("turkey", "turkiye"),
    "United Arab Emirates": ("uae", "u a e", "united arab emirates", "dubai"), "Canada": ("canada",), "Australia": ("australia",), "Italy": ("italy",), "France": ("france",),
    "Spain": ("spain",), "Netherlands": ("netherlands", "holland"), "Japan": ("japan",), "South Korea": ("south korea", "korea"), "Saudi Arabia": ("saudi arabia", "ksa"),
    "Sri Lanka": ("sri lanka",), "India": ("india",),
}
#: Document types and how they are written, as slugs.
ALIASES = {
    "certificate_of_origin": ("certificate_of_origin", "coo", "origin_certificate"), "commercial_invoice": ("commercial_invoice", "invoice"), "packing_list": ("packing_list", "packing"),
    "form_e": ("form_e", "e_form", "electronic_form_e"), "irrevocable_letter_of_credit": ("irrevocable_letter_of_credit", "letter_of_credit", "lc"),
    "phytosanitary_certificate": ("phytosanitary_certificate", "phyto"), "sbp_deposit_proof": ("sbp_deposit_proof", "deposit_proof"),
}


#: Supporting documents and how they are written, as slugs.
SUPPORTING_TYPES = {
    "form_e_or_psw_export_declaration": ("form_e", "forme", "psw_export_declaration", "form_e_or_psw_export_declaration", "form_e_psw_export_declaration", "form_e_export_declaration", "export_declaration", "psw_declaration"),
    "certificate_of_origin": ("certificate_of_origin", "coo", "cpfta_certificate_of_origin", "certificate_of_origin_cpfta", "preferential_certificate_of_origin", "non_preferential_certificate_of_origin"),
    "sbp_deposit_proof": ("sbp_deposit_proof", "proof_of_sbp_deposit", "sbp_deposit_receipt", "state_bank_of_pakistan_deposit_proof"),
    "sbp_confirmation": ("sbp_confirmation", "state_bank_of_pakistan_confirmation"),
    "irrevocable_letter_of_credit": ("irrevocable_letter_of_credit", "letter_of_credit", "lc", "irrevocable_lc", "documentary_credit"),
    "phytosanitary_certificate": ("phytosanitary_certificate", "phyto_certificate", "plant_health_certificate"),
    "importing_country_permit": ("import_permit", "importing_country_permit", "importing_country_import_permit"),
    "goods_declaration": ("goods_declaration", "export_goods_declaration"), "bill_of_lading": ("bill_of_lading", "ocean_bill_of_lading"), "export_contract": ("export_contract", "export_sales_contract", "sales_contract"),
}
#: Documents of a request and how they are written; others keep their slug.
INPUT_TYPES = {
    "commercial_invoice": ("invoice", "commercial_invoice"), "packing_list": ("packing_list",), "form_e": ("form_e", "forme"),
    "sbp_deposit_proof": ("sbp_deposit_proof", "proof_of_sbp_deposit", "proof_of_1_sbp_deposit", "proof_of_1_percent_sbp_deposit"), "sbp_confirmation": ("sbp_confirmation", "sbp_confirmation_letter"),
    "irrevocable_letter_of_credit": ("irrevocable_letter_of_credit", "letter_of_credit", "lc"), "phytosanitary_certificate": ("phytosanitary_certificate", "phyto_certificate"),
    "certificate_of_origin": ("certificate_of_origin", "coo"), "import_permit": ("import_permit",), "product_permit": ("product_permit",), "product_licence": ("product_licence", "product_license"),
    "product_certificate": ("product_certificate",), "product_approval": ("product_approval",),
}


def _slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_|_$", "")


def input_type(x: Column) -> Column:
    """The name of a request's document; one that is not known keeps its own, as a slug."""
    slug = _slug(x)
    return F.coalesce(*[F.when(slug.isin(*s), F.lit(k)) for k, s in INPUT_TYPES.items()], slug)


def supporting_type(x: Column) -> Column:
    """A supporting document's type by one of its spellings; else the only type with a spelling among the words; else unknown."""
    slug = _slug(x)
    wide = F.concat(F.lit("_"), slug, F.lit("_"))
    held = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(wide, F.lit(f"_{s}_")) for s in ss if len(s) >= 3]), F.lit(k)) for k, ss in SUPPORTING_TYPES.items()]))
    return F.coalesce(*[F.when(slug.isin(*s), F.lit(k)) for k, s in SUPPORTING_TYPES.items()], F.when(F.size(held) == 1, F.get(held, F.lit(0))), F.lit("unknown"))


def citation_snippet(x: Column, width: int = 320) -> Column:
    """At most ``width`` characters, the last of which then stands for the rest."""
    return F.when(F.length(x) > width, F.concat(F.regexp_replace(F.substring(x, 1, width - 1), r"\s+$", ""), F.lit("…"))).otherwise(x)


def injections(x: Column) -> Column:
    """The first phrase of each kind found, joined; empty if none."""
    return F.array_join(F.array_compact(F.array(*[F.nullif(F.regexp_extract(x, f"(?i)({r})", 1), F.lit("")) for r in INJECTION])), "|")


def flat(x: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


#: Spellings in the order of the table, and the longest first; each between blanks, as in ``flat``.
SPELLED = [(f" {s} ", k) for k, names in DESTINATIONS.items() for s in names]
LONGEST_FIRST = sorted(SPELLED, key=lambda p: (-len(p[0]), p[0]))
_SPELLED, _LONGEST = (phrase_numbers([s for s, _ in xs]) for xs in (SPELLED, LONGEST_FIRST))


def _first_name(numbers: Column, spelled: list[tuple[str, str]]) -> Column:
    """The destination of the least number, which comes first in ``spelled``."""
    return F.get(F.array(*[F.lit(k) for _, k in spelled]), F.get(numbers, F.lit(0)))


def destination(x: Column) -> Column:
    """The canonical destination: the first in the table of which a spelling stands in the text."""
    return _first_name(_SPELLED(flat(x)), SPELLED)


def asked_destination(x: Column) -> Column:
    """What a question names as destination, without what follows "from"; the longest spelling wins."""
    froms = "|".join(s.strip() for s, _ in [*LONGEST_FIRST, ("pakistan", ""), ("pak", "")])
    return _first_name(_LONGEST(F.regexp_replace(flat(x), rf" from (the )?({froms})(?= )", " ")), LONGEST_FIRST)


def document_type(x: Column) -> Column:
    """A type's name for one of its spellings; else the only type whose spelling the words hold; else UNKNOWN."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_|_$", "")
    exact = F.coalesce(*[F.when(slug.isin(*s), F.lit(k)) for k, s in ALIASES.items()])
    wide = F.concat(F.lit("_"), slug, F.lit("_"))
    held = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(wide, F.lit(f"_{s}_")) for s in ss]), F.lit(k)) for k, ss in ALIASES.items()]))
    return F.coalesce(exact, F.when(F.size(held) == 1, held[0]), F.lit("UNKNOWN"))


def source_kind(stored: Column, kind: Column, title: Column, authority: Column) -> Column:
    """The stored kind; else a marker; else by type; else, if a government body issued it, by title."""
    government = F.coalesce(authority.rlike(r"(?i)ministry|government|customs|revenue|state bank"), F.lit(False))
    derived = (
        F.when(title.rlike("(?i)fixture"), "test_fixture").when(title.rlike("(?i)curated|requirements"), "curated_rule_summary")
        .when(kind == "tariff", "official_tariff").when(kind.isin("customs_act", "customs_rules"), "official_regulation").when(kind == "manual", "official_manual")
        .when(government & title.rlike("(?i)policy"), "official_policy").when(government & title.rlike("(?i)procedure"), "official_procedure").otherwise("unclassified")
    )
    return F.coalesce(stored, derived)


def verification(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return (
        F.when(low == "", "unverified").when(F.contains(low, F.lit("portal_limitation")), "partially_verified").when(F.contains(low, F.lit("conflict")), "conflicting")
        .when(F.contains(low, F.lit("inaccessible")) | F.contains(low, F.lit("portal database error")), "inaccessible")
        .when(F.startswith(low, F.lit("verified")) | F.contains(low, F.lit("manually_verified")) | F.contains(low, F.lit("verified_from")), "verified").otherwise("unverified")
    )


def field_path(x: Column) -> Column:
    """struct(document, index, field) of ``doc.line_items[n].field`` or ``doc.field``."""
    r = r"^([a-z_]+)(?:\.(?:line_items|items)\[(\d+)\])?\.([a-z_]+)$"
    return F.struct(*[F.nullif(F.regexp_extract(x, r, k), F.lit("")).alias(n) for k, n in enumerate(("document", "index", "field"), start=1)])


def joined_once(parts: Column) -> Column:
    """Parts in order, without nulls and without repeats that differ in case only, joined."""
    kept = F.array_compact(parts)
    low = F.transform(kept, F.lower)
    return F.array_join(F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), " ")


def snippet(x: Column, width: int = 420) -> Column:
    """Blanks collapsed; cut after the last sentence or clause before ``width``, else the last blank."""
    flat_ = F.trim(F.regexp_replace(x, r"\s+", " "))
    head = F.substring(flat_, 1, width)
    stop = F.length(F.regexp_extract(head, r"^(.*[.;]) ", 1))
    blank = F.length(F.regexp_extract(head, r"^(.*) ", 1))
    cut = F.when(stop > 0, F.substring(head, F.lit(1), stop)).when(blank > 0, F.concat(F.substring(head, F.lit(1), blank), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(flat_) <= width, flat_).otherwise(cut)


def correction_basis(value: Column, ocr_required: Column, method: Column, confidence: Column, status: Column) -> Column:
    unsure = confidence < 0.90
    return (
        F.when(value.isNull() | ocr_required, "parser_error").when((method == "ocr") & unsure, "ambiguous_ocr").when(unsure, "low_confidence")
        .when(confidence.isNull() & (status != "verified"), "confirm").otherwise("document_mismatch")
    )


def legal_predicates(source: Column, sro: Column, authority: Column, check_id: Column) -> list[Column]:
    """Three different senses of legal: regulatory check, check of the system's own scope, legal check."""
    scope = check_id.isin("mvp_pct_support", "required_fields")
    return [((source.isNotNull() | sro.isNotNull()) & ~scope).alias("is_regulatory"), scope.alias("is_scope"), (authority.isNotNull() | sro.isNotNull()).alias("is_legal")]


def readable(x: Column) -> Column:
    """For display: keys to words, bracketed references off, blanks collapsed."""
    bare = F.regexp_replace(x, r"\s*\[(?:ref|evidence):[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<=[a-z])_(?=[a-z])", " "), r"\s+", " "))
