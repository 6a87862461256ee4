"""Benchmark passages found by an FM-index of each shard of the corpus.

A shard is a batch of documents as a task reads them. Its words become numbers: those that occur
in no benchmark item cut the text, and runs of the others too short for any window are left out,
as no window can lie in them. Over the rest a suffix array is built, from it the Burrows-Wheeler
transform, kept as a wavelet matrix whose bit ranks answer occurrence counts. All windows are
searched backward at once, a word a step; rows found are walked to the next sampled suffix
position, which locates the occurrence. Overlapping occurrences merge into removal spans.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one
window. The windows are sent to all tasks in blocks of items of ``BLOCK_BYTES`` at most, so what is
broadcast stays bounded; spans of several blocks are merged. There is no shuffle for one block.

Defined results: a null or empty text has no words and no span; an item without words matches
nothing; an item without an id marks words but cannot be listed; an item given twice is listed
twice; an empty benchmark or document table gives clean, or no, rows; any extra columns asked for
by ``keep`` pass through unread, whatever their names; one that is named like a result is given up.
A very long text is a shard of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, shipped

WINDOW = 10
#: Bytes of item texts sent to all tasks at once.
BLOCK_BYTES = 16 << 20
#: Words of a shard, but that a document is never cut; every so many suffix positions is sampled.
SHARD_WORDS, SAMPLE = 1_000_000, 8
#: Lower-cases A-Z; whatever is neither a digit, a-z nor beyond ASCII becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Windows:
    """The distinct windows of the items as numbers of words, and which items each belongs to."""

    def __init__(self, items: Sequence[tuple[str | None, bytes | None]], width: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        of: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(seq) - width + 1) if seq else 0):
                of.setdefault(tuple(seq[at : at + width]), set()).add(k)
        self.length = np.array([len(w) for w in of], dtype=np.int64)
        self.words = np.zeros((len(of), width), dtype=np.int64)  # last word first
        for k, w in enumerate(of):
            self.words[k, : len(w)] = w[::-1]
        self.items = [sorted(x) for x in of.values()]
        self.least = int(self.length.min()) if len(of) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling, until all ranks differ; ``text`` must end in a symbol that it holds once."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Of a text of numbers from 1 on; ``ends`` are the positions of its separators, held as 0."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, top: int):
        n = len(text)
        distinct = text + len(ends)
        distinct[ends] = np.arange(len(ends))  # each separator a symbol of its own
        order = suffix_array(distinct)
        self.bwt = text[order - 1]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        self.levels = []
        seq = self.bwt
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            rank = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(ones, out=rank[1:])
            self.levels.append((bit, rank, n - int(rank[-1])))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))
        sampled = order % SAMPLE == 0
        starts = np.concatenate(([0], ends[:-1] + 1))
        first = np.zeros(n + 1, dtype=bool)
        first[starts] = True
        sampled |= first[order]
        self.sampled, self.sample_rank, self.samples, self.n = sampled, np.cumsum(sampled) - 1, order[sampled], n

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            up = (symbol >> bit) & 1 == 1
            a, s = ones[at], ones[start]
            at, start = np.where(up, zeros + a, at - a), np.where(up, zeros + s, start - s)
        return at - start

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, row after the last) of each window that occurs."""
        which = np.arange(len(windows.length))
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), self.n, dtype=np.int64)
        for step in range(windows.words.shape[1]):
            go = windows.length[which] > step
            symbol = windows.words[which, step]
            base = self.below[symbol]
            low = np.where(go, base + self.rank(symbol, low), low)
            high = np.where(go, base + self.rank(symbol, high), high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row of the suffix array."""
        found, steps, todo = np.empty(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows]
            found[todo[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            todo, rows, steps = todo[~done], rows[~done], steps + 1
            symbol = self.bwt[rows]
            rows = self.below[symbol] + self.rank(symbol, rows)
        return found


def search_shard(docs: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Removal spans (document, first word, word after the last) and pairs (document, window).

    docs: the numbers of each document's words, 0 where no item has the word.
    """
    none = np.zeros(0, dtype=np.int64)
    size = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.concatenate([np.append(d, 0) for d in docs]) if docs else none
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat != 0, [0]))))
    start, end = edge[::2], edge[1::2]
    fit = end - start >= windows.least
    start, end = start[fit], end[fit]
    if not len(start):
        return none, none, none, none, none
    length = end - start + 1  # with a separator, which is the 0 that follows
    ends = np.cumsum(length) - 1
    at = np.arange(ends[-1] + 1) + np.repeat(start - np.concatenate(([0], ends[:-1] + 1)), length)
    index = FMIndex(flat[at], ends, len(windows.number))
    which, low, high = index.search(windows)
    if not len(which):
        return none, none, none, none, none
    count = high - low
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    place, which = at[index.locate(rows)], np.repeat(which, count)
    cover = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + windows.length[which], -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0]))))
    first = np.concatenate(([0], np.cumsum(size + 1)))
    doc_of = lambda x: np.searchsorted(first, x, side="right") - 1
    doc = doc_of(edge[::2])
    pairs = np.unique(np.stack((doc_of(place), which)), axis=1)
    return doc, edge[::2] - first[doc], edge[1::2] - first[doc], pairs[0], pairs[1]


def search_batch(texts: list[bytes | None], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """(number of words, spans, ids of items) of each text, shard by shard."""
    n_words, spans, items = [], [[] for _ in texts], [[] for _ in texts]
    shard, base, held = [], 0, 0
    number = windows.number.get
    for k, text in enumerate(texts):
        words = words_of(text)
        n_words.append(len(words))
        shard.append(np.fromiter((number(w, 0) for w in words), dtype=np.int64, count=len(words)))
        held += len(words)
        if held >= SHARD_WORDS or k == len(texts) - 1:
            if windows.least:
                doc, start, end, by, which = search_shard(shard, windows)
                for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist()):
                    spans[base + d].append((s, e))
                seen: dict[int, set[int]] = {}
                for d, w in zip(by.tolist(), which.tolist()):
                    seen.setdefault(base + d, set()).update(windows.items[w])
                for d, x in seen.items():
                    items[d] = sorted(windows.ids[i] for i in x if windows.ids[i] is not None)
            shard, base, held = [], k + 1, 0
    return n_words, spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with n_words, spans of words, items found."""
    spark = shipped(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    stated = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("binary").alias("text"))
    n_bytes = stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    columns = {"_text": F.col(text_col).cast("binary"), "_kept": F.struct(*keep)}
    # blocks of items meet by row, so rows are numbered and written if there are several
    source = numbered(docs, **columns) if blocks > 1 else docs.select(F.lit(0).cast("long").alias("_row"), *[c.alias(n) for n, c in columns.items()])
    carried = ["_kept"] if blocks == 1 else ["_row"]
    schema = T.StructType([*(source.schema[c] for c in carried), *RESULT.fields])

    def searched(block: int) -> DataFrame:
        part = stated if blocks == 1 else stated.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        windows = spark.sparkContext.broadcast(Windows([(r["id"], bytes(r["text"]) if r["text"] is not None else None) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("_text").to_pylist()
                n_words, spans, items = search_batch(texts, windows.value)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in carried), pa.array(n_words, pa.int64()),
                    pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string())),
                ], names=schema.names)

        return source.mapInArrow(run, schema)

    if blocks == 1:
        return searched(0).select("_kept.*", *RESULT.names)
    # spans of several blocks of items: gathered by row, sorted, and joined where they touch
    every = searched(0)
    for block in range(1, blocks):
        every = every.unionByName(searched(block))
    merged = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:int,end:int>>),
        (a, x) -> if(size(a) > 0 and element_at(a, -1).end >= x.start,
          concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
          concat(a, array(x))))"""
    found = every.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.expr(merged).alias("spans"), F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))
    return source.select("_kept", "_row").join(found, "_row").select("_kept.*", *RESULT.names)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of what ``decontaminate`` returns."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0))
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
