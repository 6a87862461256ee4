"""Search tokens, n-gram features, and the hashing embedder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of law that count as one.
LEGAL_STEMS = {
    "confiscated": "confiscate", "confiscation": "confiscate", "declarations": "declaration", "officers": "officer", "powers": "power",
    "seized": "seize", "seizing": "seize", "seizure": "seize", "submission": "submit", "submitted": "submit", "submitting": "submit",
}
DIMENSION = 256


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1)


def tokens(x: Column) -> Column:
    """Words with legal stems, then a token for each product code and each notice number."""
    low = F.lower(x)
    stems = F.create_map(*[F.lit(v) for pair in LEGAL_STEMS.items() for v in pair])
    plain = F.transform(words(x), lambda w: F.coalesce(F.try_element_at(stems, w), w))
    codes = F.transform(F.regexp_extract_all(low, F.lit(r"\b(\d{4}\.?\d{4})\b"), 1), lambda c: F.concat(F.lit("pct"), F.replace(c, F.lit("."), F.lit(""))))
    notice = r"(\d{2,4}\s*\(?\s*i\s*\)?\s*[/\-]?\s*\d{4})"
    notices = F.transform(F.regexp_extract_all(low, F.lit(notice), 1), lambda n: F.regexp_replace(n, r"^(\d{2,4}).*?(\d{4})$", "sro$1i$2"))
    return F.concat(plain, codes, notices)


def features(x: Column) -> Column:
    """Words, word pairs, and runs of three characters of the blank-collapsed text."""
    w = words(x)
    flat = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
    grams = F.when(F.length(flat) > 2, F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: F.substring(flat, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs, grams)


class FeatureHashes(dict):
    """64-bit hashes of features, kept while there is room."""

    def __missing__(self, feature: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[feature] = h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        return h


_HASHES = FeatureHashes()


def _embed(text: str, size: int) -> np.ndarray:
    low = text.lower()
    w = re.findall("[a-z0-9]+", low)
    flat = " ".join(low.split())
    found = [*w, *map("_".join, zip(w, w[1:])), *map("".join, zip(flat, flat[1:], flat[2:]))]
    h = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    # sums of whole numbers, exact in any order
    out = np.bincount((h >> np.uint64(1)).astype(np.int64) % size, weights=np.where(h & np.uint64(1), 1.0, -1.0), minlength=size)
    length = np.linalg.norm(out)
    return out / length if length else out


def embedder(size: int = DIMENSION):
    """A column function: signed feature hashing, of length one; batches go through Arrow."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: _embed(t, size).astype(np.float32))

    return embed


def cosine(a: Column, b: Column) -> Column:
    """The dot product in doubles; 0 where the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)
