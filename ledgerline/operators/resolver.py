"""Words of a question to catalogued products: repairs, plurals, aliases, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import words


def repaired(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens of four letters or more not in the vocabulary, repaired if one word only is at distance 1.

    Each word is joined by itself with each one letter less, so no token meets the whole
    vocabulary; the distance is then taken.
    """
    keys = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    unknown = tokens.where(F.length("token") >= 4).join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti").select("token").distinct()
    left = unknown.select("token", F.explode(keys(F.col("token"))).alias("_key"))
    right = vocabulary.select("word", F.explode(keys(F.col("word"))).alias("_key"))
    near = left.join(right, "_key").select("token", "word").distinct().where(F.levenshtein("token", "word", 1) == 1)
    return near.groupBy("token").agg(F.min("word").alias("word"), F.count("*").alias("n")).where("n = 1").select("token", "word")


def singular(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """-ies to y, -es and -s off, where the stem is a known word."""
    t = F.col("token")
    stems = F.array_compact(F.array(F.when(t.endswith("ies"), F.concat(F.expr("left(token, length(token) - 3)"), F.lit("y"))), F.when(t.endswith("es"), F.expr("left(token, length(token) - 2)")), F.when(t.endswith("s"), F.expr("left(token, length(token) - 1)"))))
    options = tokens.select("token").distinct().select("token", F.posexplode(stems).alias("place", "word"))
    return options.join(vocabulary.select("word").distinct(), "word").groupBy("token").agg(F.min_by("word", "place").alias("word"))


def resolved(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(question_id, code): products whose name's words all stand in the question, the longest kept.

    Names meet questions by word, never all by all; several of equal length stay ambiguous.
    """
    names = catalog.select("code", F.array_distinct(words(F.col("name"))).alias("_words"))
    asked = questions.select("question_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    hits = names.select("code", F.size("_words").alias("_size"), F.explode("_words").alias("word")).join(asked, "word").groupBy("question_id", "code", "_size").agg(F.count("*").alias("n"))
    whole = hits.where("n = _size")
    best = whole.groupBy("question_id").agg(F.max("n").alias("_most"), F.count("*").alias("candidates"))
    return whole.join(best, "question_id").where("n = _most").select("question_id", "code", "n")


def description_conflicts(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items whose description overlaps another product's name strictly better, by 0.6 or more.

    The catalog is a configured table of few rows.
    """
    names = catalog.select(F.col("code").alias("other"), F.array_distinct(words(F.col("name"))).alias("_name"))
    described = items.select("item_id", "code", F.array_distinct(words(F.col("description"))).alias("_words"))
    by_word = described.select("item_id", "code", F.explode("_words").alias("w")).join(names.select("other", F.size("_name").alias("_size"), F.explode("_name").alias("w")), "w")
    scores = by_word.groupBy("item_id", "code", "other", "_size").agg(F.count("*").alias("n")).withColumn("score", F.col("n") / F.col("_size"))
    own = scores.where("code = other").select("item_id", F.col("score").alias("own"))
    rest = scores.where("code <> other").groupBy("item_id", "code").agg(F.max(F.struct("score", "other")).alias("best"))
    joined = rest.join(own, "item_id", "left")
    return joined.where((F.col("best.score") >= 0.6) & (F.col("best.score") > F.coalesce("own", F.lit(0.0)))).select("item_id", "code", F.col("best.other").alias("other"), F.round("best.score", 4).alias("score"))


# What wording names products, and the codes that it may mean.
PHRASES = (
    (r"\bt\s+shirts?\b", "t-shirt", ("61091000",)), (r"\braw\s+cotton\b", "raw cotton", ("52010090",)), (r"\bcotton\s+lint\b", "cotton lint", ("52010090",)),
    (r"\bcombed\s+(cotton\s+)?yarn\b", "combed yarn", ("52052100",)), (r"\bterry\s+towels?\b", "terry towel", ("63026010",)), (r"\bbed\s+sheets?\b", "bed sheet", ("63023110",)),
)
WORDS = {
    "pants": ("62034200", "62046290"), "trousers": ("62034200", "62046290"), "slacks": ("62034200", "62046290"), "breeches": ("62034200", "62046290"), "t-shirt": ("61091000",), "tshirt": ("61091000",),
    "tee": ("61091000",), "blouse": ("61061000",), "blouses": ("61061000",), "jersey": ("61102000",), "pullover": ("61102000",), "cardigan": ("61102000",), "sweater": ("61102000",),
    "shirt": ("61051000", "62052090"), "shirts": ("61051000", "62052090"), "towel": ("63026010",), "towels": ("63026010",), "blanket": ("63013000",), "blankets": ("63013000",),
    "bedsheet": ("63023110",), "bedsheets": ("63023110",), "bedlinen": ("63023110",), "jeans": ("62034200", "62046290"), "yarn": ("52051100", "52052100"), "denim": ("52094200", "52114200"),
    "fabric": ("52085200", "52093100", "52094200", "52114200"),
}
MATERIALS = ("yarn", "denim", "fabric")
SIGNALS = ("cotton", "textile", "textiles", "fabric", "cloth", "garment", "garments", "apparel", "clothing", "knitted", "woven", "denim", "yarn", "terry", "linen", "wear")
#: Qualifiers and the codes that they narrow to; of the first two and of the last two, the first that holds.
MENS, WOMENS = ("men", "mens", "man", "male", "boy", "boys", "gents", "gentlemen"), ("women", "womens", "woman", "female", "girl", "girls", "ladies", "lady")
KNITTED, WOVEN = ("knitted", "knit", "crocheted", "jersey"), ("woven", "weave")
NARROW = (
    ((MENS, ("62034200", "61051000", "62052090", "61091000")), (WOMENS, ("62046290", "61061000"))),
    ((KNITTED, ("61051000", "61061000", "61091000", "61102000")), (WOVEN, ("62034200", "62046290", "62052090", "52085200", "52093100", "52094200", "52114200"))),
)
FRAMING = tuple(
    "a an the my our of for to from in on and or about please tell me i want need help with export exports exporting shipment shipments ship shipping consignment goods product products item items requirement requirements document documents documentation paperwork papers checklist rules".split()
)
KNOWN = tuple(dict.fromkeys([*WORDS, *SIGNALS, *MENS, *WOMENS, *KNITTED, *WOVEN]))
NAMING = tuple(dict.fromkeys([*KNOWN, *(w for _, term, _ in PHRASES for w in term.split()), *(f"{w}s" for w in KNOWN), *(f"{w}es" for w in KNOWN)]))


def product_meaning(x, supported: list[str]):
    """struct(code, candidates, term): which supported products the wording may mean.

    A phrase before an article before a material; qualifiers narrow it; several codes stay
    ambiguous. Words are taken as known or in a known singular; without any word of textiles
    nothing is meant.
    """
    text = F.array(*map(F.lit, ())).cast("array<string>")
    known = F.array(*map(F.lit, KNOWN))
    raw = F.transform(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([a-z][a-z'-]*)"), 1), lambda t: F.replace(t, F.lit("'"), F.lit("")))
    stem = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    word = lambda t: (
        F.when(F.array_contains(known, t), t).when(t.endswith("ies") & F.array_contains(known, F.concat(stem(t, 3), F.lit("y"))), F.concat(stem(t, 3), F.lit("y")))
        .when(t.endswith("es") & F.array_contains(known, stem(t, 2)), stem(t, 2)).when(t.endswith("s") & F.array_contains(known, stem(t, 1)), stem(t, 1)).otherwise(t)
    )
    tokens = F.transform(raw, word)
    textile = F.arrays_overlap(tokens, F.array(*map(F.lit, [*WORDS, *SIGNALS])))
    joined = F.array_join(tokens, " ")
    codes_of = F.create_map(*[v for w, c in WORDS.items() for v in (F.lit(w), F.array(*map(F.lit, c)))])
    usable = F.array(*map(F.lit, supported))
    phrase = F.coalesce(*[F.when(joined.rlike(p), F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, c)).alias("codes"))) for p, t, c in PHRASES])
    by_phrase = F.array_intersect(F.coalesce(phrase["codes"], text), usable)
    words_ = F.filter(tokens, lambda t: t.isin(*WORDS))
    articles = F.filter(words_, lambda t: ~t.isin(*MATERIALS))
    term = F.when(F.size(articles) > 0, F.get(articles, F.lit(0))).otherwise(F.get(words_, F.lit(0)))
    codes = F.array_intersect(F.coalesce(F.try_element_at(codes_of, term), text), usable)
    said = lambda q: F.arrays_overlap(tokens, F.array(*map(F.lit, q)))
    kept = lambda c, keep: F.when(F.size(F.array_intersect(c, F.array(*map(F.lit, keep)))) > 0, F.array_intersect(c, F.array(*map(F.lit, keep)))).otherwise(c)
    for (q1, k1), (q2, k2) in NARROW:  # an array of one binds the codes so far
        codes = F.get(F.transform(F.array(codes), lambda c: F.when(said(q1), kept(c, k1)).when(said(q2), kept(c, k2)).otherwise(c)), F.lit(0))  # noqa: B023
    final = F.when(~textile, text).when(F.size(by_phrase) > 0, by_phrase).otherwise(codes)
    named = F.when(textile, F.when(F.size(by_phrase) > 0, phrase["term"]).otherwise(term))
    return F.struct(F.when(F.size(final) == 1, F.get(final, F.lit(0))).alias("code"), F.size(final).alias("candidates"), named.alias("term"))


def is_bare_product(x):
    """Whether the question names a product, or frames one, and says nothing else."""
    words_ = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9'-]*)"), 1)
    return F.size(F.filter(words_, lambda w: ~w.isin(*FRAMING) & ~w.isin(*NAMING))) == 0
