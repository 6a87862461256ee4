"""File sources and sinks, through Spark's readers and writers only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import dense_numbers

PDF, ZIP, MOST_BYTES = "255044462D", "504B0304", 20 << 20


#: MIME types by kind of file, and a member that every text document in a ZIP has.
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
MEMBER = "word/document.xml"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with what their content says they are; too large or other ones are refused, by the first reason.

    Empty files are none to Spark's reader.
    """
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 5))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(head == PDF, "pdf").when(F.startswith(head, F.lit(ZIP)), "docx")
    expected = F.lower(F.regexp_extract(name, r"\.(\w+)$", 1))
    member = F.instr(F.decode("content", "ISO-8859-1"), MEMBER) > 0  # names of members stand uncompressed
    reason = (
        F.when(F.col("length") > MOST_BYTES, "too large").when(kind.isNull(), "unknown content").when(kind != expected, "content differs from name")
        .when((kind == "docx") & ~member, "not a text document")
    )
    mime = F.coalesce(*[F.when(kind == k, m) for k, m in MIME.items()])
    return files.select(name.alias("file_name"), F.col("length").alias("size"), kind.alias("kind"), mime.alias("mime"), F.sha2("content", 256).alias("checksum"), reason.alias("refused"))


def text_units(spark: SparkSession, path: str) -> DataFrame:
    """One unit for each text file: slug, page (null), unit, text."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    slug = F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1)), "[^a-z0-9]+", "-")
    return files.select(slug.alias("slug"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("unit"), F.col("value").alias("text"))


def page_units(pages: DataFrame, first: int | None = None, last: int | None = None, relevant: str | None = None) -> DataFrame:
    """Page units in a range whose text matches; both filters reach the scan as far as they can."""
    if first is not None:
        pages = pages.where(F.col("page") >= first)
    if last is not None:
        pages = pages.where(F.col("page") <= last)
    return pages.where(F.col("text").rlike(f"(?i){relevant}")) if relevant else pages


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A configured catalog: pct_codes and products of a JSON file, by code, with a default category."""
    schema = "pct_codes array<string>, products array<struct<pct_code:string,simple_product_name:string,validation_status:string,textile_category:string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    codes = doc.select(F.explode("pct_codes").alias("code"))
    products = doc.select(F.inline("products")).select(F.col("pct_code").alias("code"), F.col("simple_product_name").alias("name"), "validation_status", F.coalesce("textile_category", F.lit("other")).alias("category"))
    return codes.join(products, "code", "left").orderBy("code")


def json_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of a requirements file: one common, one on origin, one for each product, in words.

    common: note and documents; origin: note; products: pct_code, name and their requirements.
    """
    schema = "common struct<note:string,documents:array<string>>, origin struct<note:string>, products array<struct<pct_code:string,name:string,licence:string,permit:string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    unit = lambda slug, text: F.struct(F.lit(slug).alias("slug") if isinstance(slug, str) else slug.alias("slug"), text.alias("text"))
    product = lambda p: unit(F.concat(F.lit("product-"), p["pct_code"]), F.concat_ws("\n", F.concat(F.lit("Product: "), p["name"]), F.concat(F.lit("PCT code: "), p["pct_code"]), F.concat(F.lit("Licence required: "), p["licence"]), F.concat(F.lit("Permit required: "), p["permit"])))
    units = F.concat(
        F.array(unit("common", F.concat_ws("\n", F.col("common.note"), F.concat(F.lit("Documents: "), F.array_join("common.documents", ", ")))), unit("origin", F.col("origin.note"))), F.transform("products", product)
    )
    return doc.select(F.posexplode(units).alias("unit", "_u")).select("_u.slug", F.lit(None).cast("int").alias("page"), "unit", "_u.text")


def config_problems(codes: DataFrame, metadata: DataFrame, requirements: DataFrame) -> DataFrame:
    """(code, problem): codes without metadata or requirements, metadata or requirements of no code, repeated ones."""
    lacks = lambda a, b, what: a.select("code").distinct().join(b.select("code"), "code", "left_anti").withColumn("problem", F.lit(what))
    twice = lambda df, what: df.groupBy("code").agg(F.count("*").alias("_n")).where("_n > 1").select("code", F.lit(what).alias("problem"))
    return (
        lacks(codes, metadata, "no metadata").unionByName(lacks(codes, requirements, "no requirements")).unionByName(lacks(metadata, codes, "metadata of no code")).unionByName(lacks(requirements, codes, "requirements of no code"))
        .unionByName(twice(metadata, "metadata repeated"))
    )


#: Digests that make one digest of the next level.
FAN = 64


def version(files: DataFrame) -> DataFrame:
    """One digest over all files' paths and contents, each with its length before it.

    Files in path order are numbered, each ``FAN`` of them make one digest, each ``FAN`` of those the next, up to
    one: no row ever holds more than ``FAN`` digests, and how files lie in partitions doesn't matter. No file: null.
    """
    part = F.concat(F.length("path").cast("string"), F.lit(":"), F.col("path"), F.lit(":"), F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256))
    level = dense_numbers(files.select("path", part.alias("digest")), [], [F.col("path"), F.col("digest")], "n").select((F.col("n") - 1).alias("n"), "digest")
    left = level.count()
    while True:
        inside = F.transform(F.array_sort(F.collect_list(F.struct("n", "digest"))), lambda x: x["digest"])
        level = level.groupBy(F.floor(F.col("n") / FAN).alias("n")).agg(F.sha2(F.array_join(inside, "|"), 256).alias("digest"))
        left = -(-left // FAN)
        if left <= 1:
            return level.agg(F.max("digest").alias("version"))


def html_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", columns: int = 4, headings: Sequence[str] | None = None) -> DataFrame:
    """Rows of tables with exactly ``columns`` cells: cells, an ISO date where the last cell is one.

    With ``headings``, only pages that have a row of just these headings count.
    """
    if headings is not None:
        cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<th[^>]*>(.*?)</th>"), 1), lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))))
        wanted = F.array(*[F.lit(h.lower()) for h in headings])
        pages = pages.where(F.exists(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), lambda tr: cells(tr) == wanted))
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "_tr"))
    cells = F.transform(F.regexp_extract_all("_tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " ")))
    found = rows.withColumn("cells", cells).where(F.size("cells") == columns)
    last = F.element_at("cells", -1)
    return found.select(id_col, "row", F.col("cells")[0].alias("number"), F.col("cells")[1].alias("title"), F.coalesce(F.try_to_date(last, "MMM d, yyyy").cast("string"), F.try_to_date(last, "MMM d yyyy").cast("string"), last).alias("date"))


def canonical_url(url: Column) -> Column:
    """Without fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([a-zA-Z]+://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href, label) of every anchor."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>'), 1)
    return pages.select("page_id", F.posexplode(found).alias("place", "href"))


def new_downloads(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose content is neither there yet nor earlier in the batch, with names that are free."""
    fresh = files.join(existing.select("checksum"), "checksum", "left_anti")
    first = fresh.groupBy("checksum").agg(F.min(F.struct("file_id", "file_name")).alias("_f")).select("checksum", "_f.*")
    numbered = dense_numbers(first, ["file_name"], [F.col("file_id")], "_again").withColumn("_again", F.col("_again") - 1)
    return numbered.select("file_id", "checksum", F.when(F.col("_again") == 0, F.col("file_name")).otherwise(F.concat("file_name", F.lit("-"), F.col("_again").cast("string"))).alias("file_name"))


def write_report(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A report sink; Spark's committer makes it appear whole or not at all."""
    df.write.mode("overwrite").format(form).save(path)
