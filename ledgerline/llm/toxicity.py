"""Toxicity by a chain of classifiers.

Categories are predicted one after the other; each model is linear in word features and in the
probabilities of the categories before it. In training those probabilities are out-of-fold: each
row's come from models that have not seen it. The label table has one category, ``toxic``; the two
before it are its grades, taken from the labelled rows and no list of words: a toxic row is
``severe`` if it has ``SEVERE`` or more distinct words that have a toxic feature, and ``explicit`` if it has one.
Toxic features are those that the rows of the other folds show, so no row labels itself.

Features are words and beginnings of words, by the number of distinct words of a text that have
them. A category's model takes the ``FEATURES`` that are most surely more frequent in its rows,
each weighed by how surely, and the strongest two of a text once more; all anew for each fold. At
most ``TRAIN_ROWS`` labelled rows, the first by a hash of their id and text, are fitted on; every row
is scored, over its whole text. The model is bounded, so it is broadcast.

Defined results: a null or empty text has no feature and gets the models' intercepts; labels that
are null, or whose id is null or in no document, do not count; without labels of both kinds all
rows get the same smoothed share, and an empty label table makes nothing toxic; an empty document
table gives no rows; repeated rows get equal scores, and count each in training; a very long text
counts as its set of distinct words; extra columns pass through if asked for, whatever their names,
but one that is named like a result is given up; ids may be of any type that labels share.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, shipped
from .decontamination import words_of
from .linear import fit, predict, sigmoid

CATEGORIES = ("severe", "explicit", "toxic")
#: Distinct words with a toxic feature that make a toxic row severe.
SEVERE = 3
#: Labelled rows, features and folds of a model; lengths in bytes of beginnings of words.
TRAIN_ROWS, FEATURES, FOLDS, BEGINNINGS = 4000, 320, 5, range(4, 9)
#: Standard errors by which evidence is lowered.
MARGIN = 2.0
THRESHOLD = 0.5
#: Words of labelled rows whose features are counted at once, or those of one row.
CHUNK = 50_000
#: Words without any feature that a task remembers.
REMEMBERED = 1_000_000


def features_of(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"-" for k in BEGINNINGS if k < len(word))]


class Sample:
    """Labelled texts as counts of features, in flat arrays."""

    def __init__(self, texts: Sequence[bytes]):
        """texts: the distinct words of each row, joined by blanks."""
        number: dict[bytes, int] = {}
        vocabulary: dict[bytes, int] = {}
        own, sizes, held = array("i"), array("i"), []  # features of each word of the vocabulary, end to end
        for text in texts:
            words = text.split()
            for w in words:
                if w not in vocabulary:
                    vocabulary[w] = len(vocabulary)
                    found = features_of(w)
                    own.extend(number.setdefault(f, len(number)) for f in found)
                    sizes.append(len(found))
            held.append(np.fromiter((vocabulary[w] for w in words), dtype=np.int32, count=len(words)))
        del vocabulary
        self.names, self.rows = list(number), len(held)
        del number
        self.size, self.features = np.array(sizes, dtype=np.int64), np.array(own, dtype=np.int32)
        self.first = np.cumsum(self.size) - self.size
        ends = np.cumsum([0, *map(len, held)])
        self.word = np.concatenate(held) if held else np.zeros(0, np.int32)
        self.row_of_word = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(ends))
        del held
        n, found, row = max(1, len(self.names)), [(np.zeros(0, np.int32),) * 3], 0
        while row < self.rows:  # whole rows, so that what one chunk counts is final and in order
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, side="right")) - 1)
            w, r = self.word[ends[row] : ends[last]], self.row_of_word[ends[row] : ends[last]]
            many = self.size[w]
            place = np.repeat(self.first[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            key, count = np.unique(np.repeat(r, many).astype(np.int64) * n + self.features[place], return_counts=True)
            found.append(((key // n).astype(np.int32), (key % n).astype(np.int32), count.astype(np.int32)))
            row = last
        self.row, self.column, self.count = (np.concatenate([x[k] for x in found]) for k in range(3))

    def chosen(self, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features most surely more frequent where ``y``, in the rows ``live``, and how surely.

        The latter is the log odds ratio less ``MARGIN`` standard errors.
        """
        use = live[self.row]
        positive = np.bincount(self.column[use & (y[self.row] == 1)], minlength=len(self.names))
        every = np.bincount(self.column[use], minlength=len(self.names))
        p, n = y[live].sum(), live.sum() - y[live].sum()
        a, b = positive + 0.5, every - positive + 0.5
        surely = np.log(a / (p + 1)) - np.log(b / (n + 1)) - MARGIN * np.sqrt(1 / a + 1 / b)
        best = np.argsort(-surely, kind="stable")[:FEATURES]
        best = best[(surely[best] > 0) & (positive[best] > 2)]
        return best, surely[best]

    def grades(self, toxic: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
        """For each row the labels of the two grades, by toxic features of the rows of other folds."""
        hits = np.zeros(self.rows)
        for k in range(FOLDS if len(self.word) else 0):
            found = np.zeros(len(self.names), dtype=bool)
            found[self.chosen(toxic, fold != k)[0]] = True
            toxic_word = np.logical_or.reduceat(found[self.features], self.first)
            each = np.bincount(self.row_of_word[toxic_word[self.word]], minlength=self.rows)
            hits = np.where((fold == k) & (toxic == 1), each, hits)
        return [(hits >= SEVERE).astype(float), (hits >= 1).astype(float)]

    def matrix(self, features: np.ndarray, surely: np.ndarray) -> np.ndarray:
        """Evidence by feature, then the strongest and the second strongest."""
        place = np.full(len(self.names), -1)
        place[features] = np.arange(len(features))
        x = np.zeros((self.rows, len(features) + 2))
        use = place[self.column] >= 0
        at = place[self.column[use]]
        x[self.row[use], at] = np.log2(1 + self.count[use]) * surely[at]
        if len(features) > 1:
            x[:, -2:] = np.sort(x[:, :-2], axis=1)[:, :-3:-1]
        return x


class Chain:
    """The fitted models: for each category the weights by feature, of earlier ones, and the intercept."""

    def __init__(self, words: Sequence[bytes], toxic: np.ndarray):
        sample, fold = Sample(words), np.arange(len(words)) % FOLDS
        labels = [*sample.grades(toxic, fold), toxic.astype(float)]
        before = np.zeros((len(words), 0))
        self.weights: dict[bytes, list[tuple[int, float, float]]] = {}
        self.strongest, self.earlier, self.base = [], [], []
        for c, y in enumerate(labels):
            held = np.zeros(len(y))
            for k in range(FOLDS):
                live = fold != k
                x = np.hstack((sample.matrix(*sample.chosen(y, live)), before))
                held[~live] = predict(x[~live], fit(x[live], y[live]))
            own, surely = sample.chosen(y, np.ones(len(y), dtype=bool))
            w = fit(np.hstack((sample.matrix(own, surely), before)), y)
            n = len(own)
            for f, v, e in zip(own.tolist(), w.tolist(), surely.tolist()):
                self.weights.setdefault(sample.names[f], []).append((c, v, e))
            self.strongest.append(w[n : n + 2])
            self.earlier.append(w[n + 2 : -1])
            self.base.append(float(w[-1]))
            before = np.hstack((before, held[:, None]))
        self.out_of_fold = before

    def score(self, texts: list[bytes | None], neutral: set[bytes]) -> np.ndarray:
        """The probability of each category for each text; ``neutral`` remembers words between calls."""
        z = np.tile(np.array(self.base), (len(texts), 1))
        for k, text in enumerate(texts):
            counts: dict[bytes, int] = {}
            for w in set(words_of(text)) - neutral:
                hit = False
                for f in features_of(w):
                    if f in self.weights:
                        counts[f] = counts.get(f, 0) + 1
                        hit = True
                if not hit:
                    neutral.add(w)
            if len(neutral) > REMEMBERED:
                neutral.clear()
            top = [[0.0, 0.0] for _ in CATEGORIES]
            for f, n in sorted(counts.items()):
                for c, v, e in self.weights[f]:
                    x = math.log2(1 + n) * e
                    z[k, c] += v * x
                    top[c] = sorted((*top[c], x))[:0:-1]
            z[k] += [w @ t for w, t in zip(self.strongest, top)]
        out = np.zeros_like(z)
        for c, w in enumerate(self.earlier):
            out[:, c] = sigmoid(z[:, c] + out[:, :c] @ w)
        return out


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [b" ".join(sorted(set(words_of(t)))) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_y"), pa.array(words, pa.binary())], names=["h", "y", "words"])

    got = labelled(docs, labels, TRAIN_ROWS, id_col, text_col, label_col).mapInArrow(run, "h long, y int, words binary").collect()  # TRAIN_ROWS at most
    got = sorted(got, key=lambda r: (r["h"], bytes(r["words"]), r["y"]))
    return Chain([bytes(r["words"]) for r in got], np.array([r["y"] for r in got]))


RESULT = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in CATEGORIES] + [T.StructField("toxic", T.BooleanType())])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the probability of each category and ``toxic``."""
    spark = shipped(docs.sparkSession)
    model = spark.sparkContext.broadcast(trained(docs, labels, id_col, text_col))
    keep = [c for c in keep if c not in RESULT.names]
    source = docs.select(F.struct(*keep).alias("_kept"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([source.schema["_kept"], *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        neutral: set[bytes] = set()
        for b in batches:
            p = model.value.score(b.column("_text").to_pylist(), neutral).round(6)
            yield pa.RecordBatch.from_arrays([b.column("_kept"), *(pa.array(p[:, c]) for c in range(len(CATEGORIES))), pa.array(p[:, -1] >= THRESHOLD)], names=schema.names)

    return source.mapInArrow(run, schema).select("_kept.*", *RESULT.names)
