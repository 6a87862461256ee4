"""Repeated byte strings, found by the interval trees of enhanced suffix arrays.

Every byte covered by a string of ``least`` bytes that starts anywhere else too is removed.

*Dealing.* A window is ``least`` bytes of a document. Its anchor is the smallest hash of the
k-grams in it, the leftmost of equals, so equal windows have equal anchors wherever they stand.
Successive windows with one anchor form a segment, which owns them; it is 3/2 windows long at most. Only anchors
that occur twice matter. If all segments of an anchor are the same string, that string is one
repeat with all its occurrences. For other anchors one copy of each distinct segment, with its
number of occurrences, goes to the task that has the anchor.

*Suffix array.* There the suffixes that begin with an owned window are sorted; common-prefix
lengths of neighbours give the interval tree, scanned with a stack. An interval of at least
``least`` bytes whose occurrences differ in the byte to their left (or stand at the left end of
their segments) is a maximal repeat; it marks all its occurrences. Others are part of a longer one.

*Large anchors.* The distinct segments of an anchor that has more than ``LARGE`` are taken as texts
of their own and dealt again by longer k-grams, which fewer of them share, and so on; at the length
of a window all segments of an anchor are equal. So each suffix array is bounded, and nothing is lost.

As windows of one segment always overlap, what is covered in a segment is one range. Ranges go
back to all occurrences, are merged by document and cut out.

Rows are numbered once, in a table written with their texts, so no number changes when a task or
an executor is lost or files are cut anew.
Defined results: a null text is empty; texts under ``least`` bytes stay whole; repeated rows are
repeats of each other, also with equal or null ids; an empty table gives no rows; very long texts
are worked on in pieces of ``PIECE`` windows; extra columns come through if asked for, whatever
their names; one that is named like a result is given up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, shipped, stored

LEAST = 400
#: Windows of a long text, and bytes of short ones, that are hashed at once.
PIECE = 1 << 20
#: Distinct segments of a suffix array at most.
LARGE = 256
#: By how much the part of a window that is no k-gram shrinks when large anchors are dealt again.
FINER = 4
#: An odd multiplier and the mixing constants of the splitmix64 finaliser.
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Anchors:
    """Cuts texts into segments of windows with one anchor."""

    def __init__(self, least: int = LEAST, gram: int = 0):
        self.least, self.gram = least, gram or max(1, least // 2)
        self.width = least - self.gram + 1
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            repeat = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64)
            self.up, self.down = repeat(BASE), repeat(pow(BASE, -1, 1 << 64))

    def smallest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of the window at each position, and whether it stands right there.

        ``data`` has one window at least.
        """
        n = len(data)
        self.powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:], dtype=np.uint64)
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1]
        h ^= h >> np.uint64(30)
        h *= np.uint64(MIX1)
        h ^= h >> np.uint64(27)
        h *= np.uint64(MIX2)
        h ^= h >> np.uint64(31)
        w = self.width
        rows = np.full(-(-len(h) // w) * w, ~np.uint64(0))
        rows[: len(h)] = h
        rows = rows.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - self.least + 1
        anchor = np.minimum(back[:count], ahead[w - 1 : w - 1 + count])
        return anchor, h[:count] == anchor

    def pieces(self, texts: list[bytes | None]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Lists of (text, offset, bytes) that are worked on at once."""
        group, held = [], 0
        for k, text in enumerate(texts):
            for at in range(0, max(0, len(text or b"") - self.least + 1), PIECE):
                group.append((k, at, text[at : at + PIECE + self.least - 1]))
                held += len(group[-1][2])
                if held >= PIECE:
                    yield group
                    group, held = [], 0
        if group:
            yield group

    def segments(self, texts: list[bytes | None]) -> Iterator[tuple[list[int], np.ndarray, list[int], list[int], list[bytes]]]:
        """(texts, anchors, starts, owned windows, segments) as parallel lists, piece by piece."""
        for group in self.pieces(texts):
            data = b"".join(x[2] for x in group)
            anchor, here = self.smallest(np.frombuffer(data, dtype=np.uint8))
            size = np.array([len(x[2]) for x in group])
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            # the leftmost of equal anchors counts, so that a text that repeats itself has many
            change = np.flatnonzero((anchor[1:] != anchor[:-1]) | here[:-1]) + 1
            start = np.unique(np.concatenate((change, first)))
            last = first + size - self.least + 1  # after the last window of each piece
            of = np.searchsorted(first, start, side="right") - 1
            end = np.minimum(np.append(start[1:], len(anchor)), last[of])
            live = start < end
            begin, stop, of = start[live], end[live], of[live]
            offset = begin - first[of] + np.array([x[1] for x in group])[of]
            extra = self.least - 1
            yield (
                [group[k][0] for k in of.tolist()], anchor[begin].view(np.int64), offset.tolist(), (stop - begin).tolist(),
                [data[a : b + extra] for a, b in zip(begin.tolist(), stop.tolist())],
            )


def maximal_repeats(segments: Sequence[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (segment, start)) of each maximal repeat of ``least`` bytes or more.

    Only suffixes of ``least`` bytes or more are sorted. A suffix at its segment's start counts as
    having a left neighbour of its own.
    """
    of = [(k, s) for k, x in enumerate(segments) for s in range(len(x) - least + 1)]
    suffix = [x[s:] for x in segments for s in range(len(x) - least + 1)]
    order = sorted(range(len(of)), key=suffix.__getitem__)
    if len(order) < 2:
        return
    wide = max(map(len, segments))
    flat = np.frombuffer(b"".join(x + bytes(wide) for x in segments), dtype=np.uint8)
    size = np.array([len(x) for x in segments])
    base = np.concatenate(([0], np.cumsum(size + wide)[:-1]))
    which = np.array(of)[order]
    rows = sliding_window_view(flat, wide)[base[which[:, 0]] + which[:, 1]]
    differ = rows[1:] != rows[:-1]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    length = size[which[:, 0]] - which[:, 1]
    prefix = np.minimum(prefix, np.minimum(length[1:], length[:-1])).tolist()
    left = [segments[k][s - 1] if s else -1 - k for k, s in (of[x] for x in order)]  # -1 - k: no neighbour
    diverse = 256
    stack: list[list[int]] = []  # [common prefix, first row, left byte of all rows or `diverse`]
    for row, depth in enumerate([*prefix, 0], start=1):
        depth = depth if depth >= least else 0
        first, byte = row - 1, left[row - 1]
        while stack and stack[-1][0] > depth:
            at, first, own = stack.pop()
            byte = own if own == byte else diverse
            if byte == diverse:
                yield at, [of[order[r]] for r in range(first, row)]
            if stack and stack[-1][0] >= depth:
                stack[-1][2] = byte if byte == stack[-1][2] else diverse
                byte = stack[-1][2]
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, first, byte])
        elif stack:
            stack[-1][2] = byte if byte == stack[-1][2] else diverse


def covered(segments: Sequence[bytes], weights: Sequence[int], least: int) -> list[tuple[int, int] | None]:
    """The range of each segment that its repeated windows cover; weights: occurrences of each."""
    low, high = [1 << 30] * len(segments), [0] * len(segments)
    for length, found in maximal_repeats(segments, least):
        for k, s in found:
            low[k], high[k] = min(low[k], s), max(high[k], s + length)
    return [(0, len(x)) if n > 1 else (a, b) if b else None for x, n, a, b in zip(segments, weights, low, high)]


def anchors_of(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(row, anchor, seg, start, owned): every segment of every text; seg is its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Anchors(least, gram)
        for batch in batches:
            row = np.array(batch.column("_row").to_pylist(), dtype=np.int64)
            for of, anchor, start, owned, parts in cut.segments(batch.column("_text").to_pylist()):
                seg = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for p in parts), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row[of]), pa.array(anchor), pa.array(seg), pa.array(start, pa.int32()), pa.array(owned, pa.int32())], names=["row", "anchor", "seg", "start", "owned"])

    return docs.select("_row", "_text").mapInArrow(run, "row long, anchor long, seg long, start int, owned int")


def tree_ranges(parts: DataFrame, least: int) -> DataFrame:
    """(anchor, seg, first, last): the covered range of each segment, by the interval tree of its anchor.

    parts: anchor, seg, weight and bytes of each distinct segment; ``LARGE`` of an anchor at most.
    """
    names = ["anchor", "seg", "first", "last"]

    def done(group: list[tuple], out: list[tuple]) -> None:
        ranges = covered([x[3] for x in group], [x[2] for x in group], least)
        out += [(x[0], x[1], *range_) for x, range_ in zip(group, ranges) if range_]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[-1][0] != x[0]:
                    done(group, out)
                    group = []
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                group.append(x)
        done(group, out)
        yield batch_of(out)

    dealt = parts.select("anchor", "seg", "weight", "bytes").repartition("anchor").sortWithinPartitions("anchor", "seg")
    return dealt.mapInArrow(scan, "anchor long, seg long, first int, last int")


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = 0) -> DataFrame:
    """(row, start, end): covered bytes of texts, one row for each segment with any.

    docs: _row (long, unique) and _text (binary), read from a table.
    """
    gram, extra = gram or max(1, least // 2), least - 1
    every = stored(anchors_of(docs, least, gram))
    # sums by key are written before they meet their rows, so that Spark can split the join of a hot key
    anchors = stored(every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("_a"), F.max("seg").alias("_b")).where("n > 1"))
    twice = stored(every.join(anchors, "anchor").select("row", "anchor", "seg", "start", "owned", (F.col("_a") == F.col("_b")).alias("same")))
    whole = twice.where("same").select("row", "start", (F.col("start") + F.col("owned") + extra).alias("end"))
    mixed = twice.where("not same")
    # one copy of each distinct segment
    one = stored(mixed.groupBy("anchor", "seg").agg(F.count("*").alias("weight"), F.min(F.struct("row", "start", "owned")).alias("at")))
    many = stored(one.groupBy("anchor").agg(F.count("*").alias("segs")))
    deal_again = gram < least and not many.where(F.col("segs") > LARGE).isEmpty()
    large = (F.col("segs") > LARGE) if deal_again else F.lit(False)
    asks = one.join(many, "anchor").select("at.row", F.struct("at.start", "at.owned", "anchor", "seg", "weight", large.alias("large")).alias("ask"))
    asked = docs.join(asks.groupBy("row").agg(F.collect_list("ask").alias("ask")), docs["_row"] == F.col("row")).select("_text", "ask")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for batch in batches:
            out = [(x["anchor"], x["seg"], x["weight"], x["large"], text[x["start"] : x["start"] + x["owned"] + extra]) for text, ask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in ask]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=["anchor", "seg", "weight", "large", "bytes"])

    parts = asked.mapInArrow(cut, "anchor long, seg long, weight long, large boolean, bytes binary")
    if not deal_again:
        ranges = tree_ranges(parts, least)
    else:
        parts = numbered(parts, anchor=F.col("anchor"), seg=F.col("seg"), weight=F.col("weight"), large=F.col("large"), bytes=F.col("bytes"))
        again = parts.where("large")
        deeper = repeated_spans(again.select("_row", F.col("bytes").alias("_text")), least, least - (least - gram) // FINER)
        deeper = deeper.join(again.select("_row", "anchor", "seg"), F.col("row") == F.col("_row")).select("anchor", "seg", F.col("start").alias("first"), F.col("end").alias("last"))
        copied = again.where("weight > 1").select("anchor", "seg", F.lit(0).alias("first"), F.octet_length("bytes").alias("last"))
        ranges = tree_ranges(parts.where("not large"), least).unionByName(deeper).unionByName(copied)
    ranges = stored(ranges.groupBy("anchor", "seg").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    part = mixed.join(ranges, ["anchor", "seg"]).select("row", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last")).alias("end"))
    return whole.unionByName(part)


RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def remove_repeats(docs: DataFrame, least: int = LEAST, text_col: str = "text", keep: Sequence[str] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``RESULT``, and ``kept`` (bytes) if ``with_text``."""
    shipped(docs.sparkSession)
    added = T.StructType([*RESULT.fields, *([T.StructField("kept", T.BinaryType())] if with_text else [])])
    keep = [c for c in keep if c not in added.names]
    rows = numbered(docs, _text=F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")), _kept=F.struct(*keep))
    spans = repeated_spans(rows.select("_row", "_text"), least).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = rows.join(spans, rows["_row"] == spans["row"], "left").select("_kept", "_text", "_spans")
    schema = T.StructType([rows.schema["_kept"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
                runs: list[list[int]] = []
                for x in spans or ():
                    if runs and x["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["end"])
                    else:
                        runs.append([x["start"], x["end"]])
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs], kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), *columns[: len(added)]], names=schema.names)

    return joined.mapInArrow(run, schema).select("_kept.*", *added.names)
