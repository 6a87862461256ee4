"""Shipments, invoices, packing lists, documents and chunks, derived from the star schema.

Money and quantities are decimals from here on; nothing is compared as a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load

#: What each document type's presence depends on: absent when o_orderkey is a multiple of the number.
DOCUMENTS = {
    "commercial_invoice": 23, "packing_list": 19, "form_e": 11, "certificate_of_origin": 3, "phytosanitary_certificate": 7,
    "sbp_deposit_proof": 5, "sbp_confirmation": 13, "irrevocable_letter_of_credit": 6, "product_licence": 4, "import_permit": 8,
}


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shipment_id, item_index, line_ref, code, product, quantity, unit_price, line_total, weights."""
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    cents, units = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    price = F.expr("(2 * cents + units) div (2 * units)")  # half up, in whole cents
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        .withColumn("item_index", F.row_number().over(order))
        .withColumn("cents", cents).withColumn("units", units)
        .select(
            F.col("l_orderkey").alias("shipment_id"), "item_index", F.col("l_linenumber").alias("line_ref"), F.col("l_partkey").alias("code"), F.col("p_name").alias("product"),
            F.col("units").cast("decimal(18,4)").alias("quantity"), (price.cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("unit_price"),
            (F.col("cents").cast("decimal(18,2)") / 100).cast("decimal(18,2)").alias("line_total"),
            F.when(F.col("item_index") % 5 != 0, F.col("units") * 2).cast("decimal(18,4)").alias("net_weight"),
            F.when(F.col("item_index") % 7 != 0, F.col("units") * 2 + F.col("l_linenumber") - 2).cast("decimal(18,4)").alias("gross_weight"),
        )
    )


def packing_items(invoice: DataFrame) -> DataFrame:
    """The invoice's items less some, with keys and quantities that fail at known places."""
    i = F.col("item_index")
    return invoice.where((F.col("shipment_id") * 31 + i * 7) % 9 != 0).select(
        "shipment_id", "item_index", F.when(i % 4 != 0, F.col("line_ref")).alias("line_ref"), F.when(i % 8 != 0, F.col("code")).alias("code"), "product",
        F.when(i % 6 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(18,4)").alias("quantity"),
        "net_weight", F.when(i % 10 != 0, F.col("gross_weight")).alias("gross_weight"),
    )


def invoice_header(invoice: DataFrame, orders: DataFrame) -> DataFrame:
    """shipment_id, declared_total, items: the true sum, 1.00 more at each fifth, null at each seventh."""
    sums = invoice.groupBy("shipment_id").agg(F.sum("line_total").alias("_sum"), F.count("*").alias("items"))
    joined = orders.select(F.col("o_orderkey").alias("shipment_id")).join(sums, "shipment_id", "left")
    total = F.coalesce("_sum", F.lit(0)).cast("decimal(18,2)")
    more = F.when(F.col("shipment_id") % 5 == 0, F.lit("1.00")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    declared = F.when(F.col("shipment_id") % 7 != 0, total + more).cast("decimal(18,2)")
    return joined.select("shipment_id", declared.alias("declared_total"), F.coalesce("items", F.lit(0)).alias("items"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shipment_id, destination, shipment_date, letter_of_credit_date, code, exporter, amount."""
    orders = load(spark, sf_dir, "orders")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    codes = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("o_orderkey") % len(CODES) + 1).cast("int"))
    day = F.to_date("o_orderdate")
    return (
        orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("shipment_id"), F.col("n_name").alias("destination"), day.alias("shipment_date"),
            F.when(F.col("o_orderkey") % 9 != 0, F.date_sub(day, (F.col("o_orderkey") % 240 - 20).cast("int"))).alias("letter_of_credit_date"),
            codes.alias("code"), F.col("c_name").alias("exporter"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )
    )


#: The product codes of the five supported commodities, the first of which is raw cotton.
CODES = ("52010090", "52051100", "52094200", "61091000", "63023110")


def shipment_documents(ships: DataFrame) -> DataFrame:
    """(shipment_id, document): what each shipment has been sent with."""
    present = F.array_compact(F.array(*[F.when(F.col("shipment_id") % n != 0, F.lit(d)) for d, n in DOCUMENTS.items()]))
    return ships.select("shipment_id", F.explode(present).alias("document"))
