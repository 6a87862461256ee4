"""URL rules by a sort-merge range join over reversed-host keys.

A host ``a.b.net`` becomes the key ``net.b.a.``; a rule on ``net`` (with all its subdomains) then
is the interval from ``net.`` up to ``net/``, since ``/`` follows ``.`` and no host holds it. Rules
on nested hosts are nested intervals. Sweeping the sorted interval ends once, with a stack, gives
for each end the rules active from there on. Rows and interval ends are sorted together by key, and
each row takes over the stack of the last end before it.

Rows are dealt to buckets by row number, never by host, and each bucket gets its own copy of the
(few) interval ends, so a host with any share of the rows is spread evenly. Everything runs as
DataFrame expressions.

Defined results: a null url, or one without ``://``, has empty host and path and meets no rule;
an empty rule set leaves every row to ``default``; rules stated twice count once, and of two that
differ in the verdict only, block wins; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rows that one bucket should hold at most, and how many buckets there are at least.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 1024


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def sweep(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """(key, rules active from there on) in key order; the stack's last rule is the innermost."""
    spans = sorted({(host_key(h), h, p, v) for h, p, v in rules}, key=lambda x: (x[0], x[2], x[3]))
    ends = sorted({k for s in spans for k in (s[0], s[0][:-1] + "/")})
    stack, out, todo = [], [], 0
    for at in ends:
        while stack and stack[-1][0][:-1] + "/" <= at:
            stack.pop()
        while todo < len(spans) and spans[todo][0] == at:
            stack.append(spans[todo])
            todo += 1
        out.append((at, [(h + p, p, v) for _, h, p, v in stack]))
    return out


def url_parts(url):
    """(host, path) columns of a url column."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([\s\S]*)$", 1)
    host = ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. rules: (host, path, verdict)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*names).alias("_row"), host.alias("_host"), path.alias("_path"))
    points = sweep(rules)
    if not points:
        return rows.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    buckets = max(LEAST_BUCKETS, -(-pages.count() // BUCKET_ROWS))
    rows = rows.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).alias("_bucket"),
        F.concat(F.array_join(F.reverse(F.split("_host", r"\.")), "."), F.lit(".")).alias("_key"),
        F.lit(1).alias("_kind"), "_row", "_host", "_path",
    )
    kind = "array<struct<rule:string,path:string,verdict:string>>"
    stack = lambda s: F.array(*[F.struct(*map(F.lit, x)) for x in s]).cast(kind)
    ends = spark.range(buckets).select(
        F.col("id").alias("_bucket"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("_key"), F.lit(0).alias("_kind"), stack(s).alias("_stack")) for k, s in points])),
    )
    swept = rows.unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy("_bucket").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("_active", F.last("_stack", ignorenulls=True).over(order)).where("_kind = 1")
    best = F.array_max(F.transform(
        F.filter(F.coalesce("_active", F.array().cast(kind)), lambda r: F.startswith(F.col("_path"), r["path"])),
        lambda r: F.struct(F.length(r["rule"]).alias("n"), r["verdict"].alias("verdict"), r["rule"].alias("rule")),
    ))
    return swept.withColumn("_best", best).select(
        "_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
