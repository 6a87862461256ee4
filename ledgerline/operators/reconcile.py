"""Checks of items, groups and totals in exact decimals, each with its null arm stated first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..status import FAILED, NOT_APPLICABLE, PASSED, REVIEW, compared, overall, within, worst


def _null(*columns: str):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def line_checks(items: DataFrame) -> DataFrame:
    """Per item: positive quantity and price, calculation (two layers), gross against net weight."""
    product = F.round(F.col("quantity") * F.col("unit_price"), 2)
    calc = within(product, F.round("line_total", 2))
    unknown = _null("quantity", "unit_price", "line_total")
    return items.select(
        "shipment_id", "item_index",
        compared(_null("quantity"), F.col("quantity") > 0, NOT_APPLICABLE).alias("positive_quantity"),
        compared(_null("unit_price"), F.col("unit_price") > 0, NOT_APPLICABLE).alias("positive_price"),
        compared(unknown, calc, NOT_APPLICABLE).alias("product_calculation"), compared(unknown, calc).alias("item_calculation"),
        compared(_null("net_weight", "gross_weight"), F.col("gross_weight") >= F.col("net_weight"), NOT_APPLICABLE).alias("weight_consistency"),
    )


def rederived(items: DataFrame) -> DataFrame:
    """The audit's own arithmetic, rounded half even, beside the engine's half up."""
    product = F.col("quantity") * F.col("unit_price") * F.lit("0.5").cast("decimal(2,1)")
    return items.select("shipment_id", "item_index", F.round(product, 2).cast("double").alias("engine"), F.bround(product, 2).cast("double").alias("audit"), (F.round(product, 2) == F.bround(product, 2)).alias("agreed"))


def order_totals(items: DataFrame, header: DataFrame) -> DataFrame:
    """The sum of line totals against the declared total; any unknown is manual_review."""
    sums = items.groupBy("shipment_id").agg(F.sum("line_total").alias("total"), F.count("*").alias("n"), F.count("line_total").alias("known"))
    joined = header.join(sums, "shipment_id", "left")
    unknown = _null("declared_total", "n") | (F.col("known") < F.col("n"))
    status = compared(unknown, within(F.round("total", 2), F.round("declared_total", 2)))
    return joined.select("shipment_id", "declared_total", "total", status.alias("status"))


def order_reconciliation(items: DataFrame, header: DataFrame) -> DataFrame:
    """One status for each shipment: its lines' calculation and its total, by the lattice."""
    lines = line_checks(items).groupBy("shipment_id").agg(F.count("*").alias("lines"), F.count_if(F.col("item_calculation") == FAILED).alias("failed_lines"), worst(F.col("item_calculation")).alias("line_status"))
    totals = order_totals(items, header)
    joined = totals.join(lines, "shipment_id", "left")
    statuses = F.explode(F.array(F.col("status"), F.coalesce("line_status", F.lit(PASSED))))
    judged = joined.select("shipment_id", "declared_total", "total", "lines", "failed_lines", F.col("status").alias("total_status"), statuses.alias("_status"))
    return judged.groupBy("shipment_id").agg(
        F.first("declared_total").cast("double").alias("declared_total"), F.first("total").cast("double").alias("line_sum"), F.coalesce(F.first("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.first("failed_lines"), F.lit(0)).alias("failed_lines"), F.first("total_status").alias("total_status"), overall(F.col("_status"), F.first("lines")).alias("overall_status"),
    )


def weight_totals(items: DataFrame, header: DataFrame) -> DataFrame:
    """Net and gross sums, unrounded, against declared ones; an undeclared total is not applicable."""
    sums = items.groupBy("shipment_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in ("net_weight", "gross_weight")], *[F.count(c).alias(f"known_{c}") for c in ("net_weight", "gross_weight")], F.count("*").alias("n"))
    joined = header.join(sums, "shipment_id")

    def check(c: str):
        return F.when(F.col(f"declared_{c}").isNull(), NOT_APPLICABLE).when(F.col(f"known_{c}") < F.col("n"), REVIEW).when(within(F.col(f"sum_{c}"), F.col(f"declared_{c}")), PASSED).otherwise(FAILED)

    return joined.select("shipment_id", check("net_weight").alias("net_status"), check("gross_weight").alias("gross_status"))


def duplicate_items(items: DataFrame) -> DataFrame:
    """Shipments with repeated line references or repeated (product, code, quantity, unit price) signatures.

    Signatures are compared null-safely and ignored where product and code are both unknown.
    """
    refs = items.where("line_ref is not null").groupBy("shipment_id", F.col("line_ref").cast("string").alias("key")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("item_index")), ",").alias("positions"))
    signature = ["product", "code", "quantity", "unit_price"]
    signed = items.where("product is not null or code is not null").groupBy("shipment_id", *signature).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("item_index")), ",").alias("positions"))
    return (
        refs.where("n > 1").select("shipment_id", F.lit("line_reference").alias("kind"), "positions", "n")
        .unionByName(signed.where("n > 1").select("shipment_id", F.lit("signature").alias("kind"), "positions", "n"))
    )


def item_comparisons(matches: DataFrame, invoice: DataFrame, packing: DataFrame) -> DataFrame:
    """Tall: (shipment_id, invoice_index, packing_index, check_id, status) for matched items.

    Quantity and weights with one side unknown are manual_review (both weights unknown: not
    applicable); codes with one side unknown are not applicable.
    """
    fields = ("quantity", "net_weight", "gross_weight", "code")
    a = invoice.select("shipment_id", F.col("item_index").alias("invoice_index"), *[F.col(c).alias(f"a_{c}") for c in fields])
    b = packing.select("shipment_id", F.col("item_index").alias("packing_index"), *[F.col(c).alias(f"b_{c}") for c in fields])
    joined = matches.where("match_status = 'matched'").join(a, ["shipment_id", "invoice_index"]).join(b, ["shipment_id", "packing_index"])

    def weight(c: str):
        both = F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull()
        return F.when(both, NOT_APPLICABLE).otherwise(compared(_null(f"a_{c}", f"b_{c}"), F.col(f"a_{c}") == F.col(f"b_{c}")))

    checks = {
        "item_quantity_match": compared(_null("a_quantity", "b_quantity"), F.col("a_quantity") == F.col("b_quantity")),
        "item_net_weight_match": weight("net_weight"), "item_gross_weight_match": weight("gross_weight"),
        "item_pct_match": compared(_null("a_code", "b_code"), F.col("a_code") == F.col("b_code"), NOT_APPLICABLE),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("status")) for k, v in checks.items()])).alias("_")
    return joined.select("shipment_id", "invoice_index", "packing_index", rows).select("shipment_id", "invoice_index", "packing_index", "_.*")


#: The checks of a shipment with one line: name of the field in words, check, field, whether as words or digits.
SINGLE = (("Product", "product_match", "product"), ("Quantity", "quantity_match", "quantity"), ("Net weight", "net_weight_match", "net_weight"), ("Gross weight", "gross_weight_match", "gross_weight"), ("PCT code", "pct_code_match", "code"))


def single_line_checks(shipments: DataFrame) -> DataFrame:
    """(shipment_id, place, check_id, status, message): seven checks of a shipment whose documents have one line each.

    shipments: shipment_id, and invoice_ and packing_ of product, quantity, net_weight, gross_weight and code. Products compare as
    words and codes as digits; a value that is unknown on either side is for review, never a failure.
    """
    bare = {"product": N.product, "code": lambda x: N.digits(x.cast("string"))}

    def compare(title: str, check: str, field: str):
        a, b = F.col(f"invoice_{field}"), F.col(f"packing_{field}")
        form = bare.get(field, lambda x: x)
        same = form(a) == form(b)
        said = [x.cast("string") for x in (a, b)]
        message = F.when(a.isNull() | b.isNull(), f"{title} could not be verified because one or both values are missing or uncertain.").when(same, f"{title} matches across both documents.")
        message = message.otherwise(F.concat(F.lit(f"{title} mismatch: invoice has '"), said[0], F.lit("' and packing list has '"), said[1], F.lit("'.")))
        return F.struct(F.lit(check).alias("check_id"), compared(a.isNull() | b.isNull(), same).alias("status"), message.alias("message"))

    def weights(document: str, prefix: str):
        net, gross = F.col(f"{prefix}_net_weight"), F.col(f"{prefix}_gross_weight")
        message = F.when(net.isNull() | gross.isNull(), "The weight relationship requires manual review.").when(gross >= net, f"{document} gross weight is valid.").otherwise(f"{document} gross weight is below its net weight.")
        return F.struct(F.lit(f"{document}_gross_not_below_net").alias("check_id"), compared(net.isNull() | gross.isNull(), gross >= net).alias("status"), message.alias("message"))

    checks = [compare(*x) for x in SINGLE]
    ordered = [*checks[:4], weights("invoice", "invoice"), weights("packing_list", "packing"), checks[4]]
    return shipments.select("shipment_id", F.posexplode(F.array(*ordered)).alias("place", "_c")).select("shipment_id", "place", "_c.*")


def single_line_input(shipments: DataFrame, checks: DataFrame) -> DataFrame:
    """What a shipment of one line brings to the rules: a field only where its own check passed."""
    passed = checks.groupBy("shipment_id").agg(*[F.bool_or((F.col("check_id") == check) & (F.col("status") == PASSED)).alias(f"_{field}") for _, check, field in SINGLE])
    return shipments.join(passed, "shipment_id").select("shipment_id", *[F.when(F.col(f"_{field}"), F.col(f"invoice_{field}")).alias(field) for _, _, field in SINGLE])


def single_document_items(matches: DataFrame) -> DataFrame:
    """How many items stand on one document only, and what that makes of the shipment."""
    counts = matches.groupBy("shipment_id").agg(*[F.count_if(F.col("match_status") == s).alias(s) for s in ("matched", "invoice_only", "packing_only")])
    return counts.withColumn("status", F.when(F.col("invoice_only") + F.col("packing_only") > 0, FAILED).otherwise(PASSED))


def masked(values: DataFrame, checks: DataFrame, strict: bool = False) -> DataFrame:
    """What goes on to the rules: an item's quantity and code only where their checks allow it.

    A check allows a value if it passed or did not apply; ``strict``, of single-line shipments,
    takes passed only.
    """
    allowed = [PASSED] if strict else [PASSED, NOT_APPLICABLE]
    wide = checks.groupBy(F.col("shipment_id").alias("_ship"), F.col("invoice_index").alias("_index")).agg(*[F.max(F.when(F.col("check_id") == f"item_{c}_match", F.col("status"))).alias(f"s_{c}") for c in ("quantity", "pct")])
    joined = values.join(wide, (F.col("shipment_id") == F.col("_ship")) & (F.col("item_index") == F.col("_index")), "left")
    return joined.select("shipment_id", "item_index", F.when(F.col("s_quantity").isin(allowed), F.col("quantity").cast("double")).alias("quantity"), F.when(F.col("s_pct").isin(allowed), F.col("code")).alias("code"))


def declared_fallback(items: DataFrame, header: DataFrame, value: str, declared: str) -> DataFrame:
    """A shipment's only item takes the declared total where its own value is unknown."""
    counts = items.groupBy("shipment_id").agg(F.count("*").alias("_n"))
    joined = items.join(counts, "shipment_id").join(header.select("shipment_id", declared), "shipment_id", "left")
    use = (F.col("_n") == 1) & F.col(value).isNull() & F.col(declared).isNotNull()
    return joined.select("shipment_id", "item_index", F.when(use, F.col(declared)).otherwise(F.col(value)).cast("double").alias(value), use.alias("derived"))


def item_rollup(fields: DataFrame) -> DataFrame:
    """An item's confidence is its least field's; its status the worst; its page the first known."""
    return fields.groupBy("shipment_id", "item_index").agg(
        F.min("confidence").alias("confidence"), F.when(F.max((F.col("status") == REVIEW).cast("int")) == 1, REVIEW).otherwise("verified").alias("status"),
        F.min_by("page", F.when(F.col("page").isNotNull(), F.col("ordinal"))).alias("page"),
    )


def declared_weights(invoice: DataFrame, packing: DataFrame, header: DataFrame) -> DataFrame:
    """(shipment_id, check_id, status): net and gross sums of both documents against their declared totals.

    header: shipment_id and declared_{invoice,packing}_{net,gross}; a document without items has nothing known.
    """
    out = header
    for name, items in (("invoice", invoice), ("packing", packing)):
        sums = items.groupBy("shipment_id").agg(F.count("*").alias(f"{name}_n"), *[f(c).alias(f"{name}_{s}_{c}") for c in ("net_weight", "gross_weight") for s, f in (("sum", F.sum), ("known", F.count))])
        out = out.join(sums, "shipment_id", "left")

    def status(name: str, kind: str):
        declared = F.col(f"declared_{name}_{kind}")
        unknown = F.col(f"{name}_n").isNull() | (F.col(f"{name}_known_{kind}_weight") < F.col(f"{name}_n"))
        return F.when(declared.isNull(), NOT_APPLICABLE).when(unknown, REVIEW).when(within(F.col(f"{name}_sum_{kind}_weight"), declared), PASSED).otherwise(FAILED)

    checks = [F.struct(F.lit(f"{n}_{k}_weight_total").alias("check_id"), status(n, k).alias("status")) for n in ("invoice", "packing") for k in ("net", "gross")]
    return out.select("shipment_id", F.inline(F.array(*checks)))
