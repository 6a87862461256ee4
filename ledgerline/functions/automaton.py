"""All phrases of a list found in one pass over a text.

The phrases become one automaton (a tree with links from each place to the longest phrase that may
still begin there), built once for each worker from the list that the function carries. A text is read once, whatever the
number of phrases; overlapping hits all count. Batches go through Arrow.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.lru_cache(maxsize=32)
def automaton(phrases: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        made.add_word(p, k)  # of equal phrases the last number stands
    made.make_automaton()
    return made


def phrase_numbers(phrases: Sequence[str]):
    """A column function: the numbers of the phrases that stand in a text, each once, ascending; none for null."""
    phrases = tuple(phrases)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(text: pd.Series) -> pd.Series:
        found = automaton(phrases).iter
        return text.map(lambda t: sorted({k for _, k in found(t)}) if t else [], na_action=None)

    return numbers


def phrase_hits(phrases: Sequence[str]):
    """A column function: every hit as struct(phrase, place), by place of its first character, from 0."""
    phrases = tuple(phrases)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("phrase", T.IntegerType()), T.StructField("place", T.IntegerType())])))
    def hits(text: pd.Series) -> pd.Series:
        found = automaton(phrases).iter
        return text.map(lambda t: [{"phrase": k, "place": p} for p, k in sorted((end - len(phrases[k]) + 1, k) for end, k in found(t))] if t else [])

    return hits


class Marks:
    """Which phrases of several named lists stand in a text: one automaton and one pass for all of them."""

    def __init__(self, **lists: Sequence[str]) -> None:
        self.phrases = tuple(dict.fromkeys(p for ps in lists.values() for p in ps))
        number = {p: k for k, p in enumerate(self.phrases)}
        self.lists = {name: sorted({number[p] for p in ps}) for name, ps in lists.items()}
        self.of = phrase_numbers(self.phrases)

    def any(self, marks: Column, name: str) -> Column:
        """Whether a phrase of the list ``name`` is among ``marks``, which ``of`` gave for the text."""
        return F.arrays_overlap(marks, F.array(*[F.lit(k) for k in self.lists[name]]))
