"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes flat numpy arrays: one symbol a character, the rank of each neighbouring pair, the
word it is in. A round takes the least rank of each word (one segmented minimum), merges its leftmost
places that don't overlap, all words at once, and compacts; words without a mergeable pair leave.

*Exact order.* The library merges one pair at a time, best score first, leftmost first. Merging all
places of a piece at once is the same unless a merge may open a pair that goes before the next
place: another piece with the same score, or a longer piece that holds this one and scores no worse.
Such ranks are found when the vocabulary is read; of them a word merges only the leftmost place in a round.

*Words* are cut wherever no piece of the vocabulary holds the two characters side by side, so no
merge crosses a cut. Equal words are encoded once for each worker (``MEMO`` words are remembered, then
forgotten together). A word that is not done after ``ROUNDS`` rounds (long runs of blanks, long runs
without blanks) is finished by a heap, in time n log n, with the same order.

Characters that no piece holds become bytes; the end id is added; nothing is sampled. Decoding joins
pieces by their ids alone: marks become blanks, bytes become characters (those that are none
become U+FFFD), control ids are silent, and the first blank is dropped.

Defined results: a null or empty text is the end id alone and decodes to the empty text; bytes that
are not UTF-8 are read as U+FFFD; repeated rows give equal rows; an empty table gives no rows; extra
columns pass through if asked for, whatever their names, but one named like a result gives way to it.
Nothing is shuffled. Memory is that of one batch of rows and of a slice of ``SLICE`` characters, or of
the longest stretch of text without a blank. The model file is read once, on the driver, and its bytes
(a vocabulary, half a megabyte here) go to the workers with the function.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped

#: Characters of texts that are worked on together, words a worker remembers, rounds before the heap.
SLICE, MEMO, ROUNDS = 2_000_000, 200_000, 128
NEVER = np.int32(2**31 - 1)
#: Fixed values of the model format: kinds of pieces, and the mark that stands for a blank.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MARK = "▁"
RESULT = ("ids", "decoded")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + n]
        at += n


class Vocabulary:
    """Pieces of a BPE model with byte fallback, as arrays."""

    def __init__(self, model: bytes) -> None:
        pieces, trainer, rules = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number in (2, 3):
                (trainer if number == 2 else rules).update(_fields(value))
        # fields of the training and normalising parts: 3 kind (2 is BPE), 24 blanks as suffix, 35 byte fallback; 2 character map, 3 first blank, 4 blanks removed, 5 blanks marked
        if (trainer.get(3, 1), trainer.get(24, 0), trainer.get(35, 0)) != (2, 0, 1) or rules.get(2) or (rules.get(3, 1), rules.get(4, 1), rules.get(5, 1)) != (1, 0, 1):
            raise ValueError("only BPE models with byte fallback whose normaliser keeps the text")
        if {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not read")
        self.size = len(pieces)
        self.end = next(i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == "</s>")
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        normal = {p.replace(MARK, " "): i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        held = sorted({c for p in normal for c in p})
        symbol = {c: normal.get(c, self.size + k) for k, c in enumerate(held)}  # some characters may be no piece
        self.char_of = {s: c for c, s in symbol.items()}
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[ord(c) for c in held]] = list(symbol.values())
        self.base = np.int64(self.size + len(held))
        rank_of = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in normal.values()}, reverse=True))}
        rank = {p: rank_of[pieces[i][1]] for p, i in normal.items()}
        self.late = np.zeros(len(rank_of) + 1, bool)  # ranks of which a word merges one place a round
        seen = np.bincount(list(rank.values()), minlength=len(rank_of))
        self.late[:-1] = seen > 1
        keys, values, inside = [], [], set()
        all_symbols = {**symbol, **normal}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                inside.add(symbol[p[k - 1]] * int(self.base) + symbol[p[k]])
                if a in all_symbols and b in all_symbols:
                    keys.append(all_symbols[a] * int(self.base) + all_symbols[b])
                    values.append((rank[p], i))
                    for part in (a, b):
                        if len(part) > 1 and rank[p] <= rank[part]:
                            self.late[rank[part]] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks, self.merged = np.array(values, np.int32)[order].T
        self.inside = np.array(sorted(inside), np.int64)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in normal if len(p) > 1))
        blank_ends = not any(re.search("[^ ] ", p) for p in normal)
        self.words = re.compile((rf" *[^ {alone}]+|[{alone}]+| +" if alone else " *[^ ]+| +") if blank_ends else "(?s).+")
        self.slices = re.compile("[^ ](?= )" if blank_ends else r"(?!)")
        surface = [p.replace(MARK, " ").encode() if k == NORMAL else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, _, k in pieces]
        self.kinds = np.array([k for _, _, k in pieces])
        self.blank_first = np.array([k == NORMAL and p.startswith(MARK) for p, _, k in pieces])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_n = np.array([len(s) for s in surface])
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n
        self.index: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.index.clear()
        self.pool, self.starts, self.counts, self.used = np.zeros(1 << 16, np.int32), np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int64), 0

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; ``NEVER`` where the two make no piece."""
        key = np.where((a < 0) | (b < 0), np.int64(-1), a * self.base + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NEVER), self.merged[at]

    def merge(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, symbols) that are left when no pair can merge; ``words`` numbers the word of each symbol, ascending."""
        n = len(symbols)
        place, done_at, done = np.arange(n), [], []
        rank, piece = np.full(n, NEVER), np.zeros(n, np.int32)
        rank[:-1], piece[:-1] = self.pairs(symbols[:-1], symbols[1:])
        rank[:-1][words[:-1] != words[1:]] = NEVER
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            length = np.diff(np.r_[first, len(words)])
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, length)
            over = best == NEVER
            if over.any():
                done_at.append(place[over])
                done.append(symbols[over])
                place, symbols, words, rank, piece, best = (x[~over] for x in (place, symbols, words, rank, piece, best))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == best)
            run = np.r_[True, at[1:] != at[:-1] + 1]
            in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            leftmost = np.r_[True, words[at[1:]] != words[at[:-1]]]
            at = at[np.where(self.late[best[at]], leftmost, in_run % 2 == 0)]
            symbols[at] = piece[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # each merge removes the symbol after it
            place, symbols, words, rank, piece = (x[stay] for x in (place, symbols, words, rank, piece))
            anew = np.unique(np.r_[at, at[at > 0] - 1])
            last = anew == len(symbols) - 1
            rank[anew[last]] = NEVER
            anew = anew[~last]
            r, p = self.pairs(symbols[anew], symbols[anew + 1])
            rank[anew], piece[anew] = np.where(words[anew] == words[anew + 1], r, NEVER), p
        if len(symbols):
            bounds = np.flatnonzero(np.r_[True, words[1:] != words[:-1], True])
            for a, b in zip(bounds[:-1], bounds[1:]):
                kept, left = self._by_heap(symbols[a:b])
                done_at.append(place[a:b][kept])
                done.append(left)
        places, left = np.concatenate(done_at or [place]), np.concatenate(done or [symbols])
        order = np.argsort(places)
        return places[order], left[order]

    def _by_heap(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word, a merge at a time."""
        sym, n = symbols.astype(np.int64).tolist(), len(symbols)
        nxt, prv, dead = [*range(1, n), -1], [*range(-1, n - 1)], bytearray(n)
        known = self.pair_dict
        base = int(self.base)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (found := known.get(sym[i] * base + sym[j])) and sym[i] >= 0 and sym[j] >= 0:
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i]
            if dead[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], dead[j], nxt[i] = to, 1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        kept = np.flatnonzero(np.frombuffer(dead, np.uint8) == 0)
        return kept, np.array(sym, np.int64)[kept].astype(np.int32)

    @functools.cached_property
    def pair_dict(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    def _learn(self, words: list[str]) -> None:
        """Encode ``words``, which are new, and remember them."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        symbols = self.of_char[chars]
        symbols = np.where(symbols < 0, -1 - chars, symbols).astype(np.int32)
        key = symbols[:-1] * self.base + symbols[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        cut = (self.inside[at] != key) | (symbols[:-1] < 0) | (symbols[1:] < 0)
        cut[ends[:-1] - 1] = True
        places, left = self.merge(symbols, np.r_[0, np.cumsum(cut)])
        as_bytes = np.flatnonzero((left < 0) | (left >= self.size))
        n = np.ones(len(left), np.int64)
        spelled = [(chr(-1 - s) if s < 0 else self.char_of[s]).replace(" ", MARK).encode() for s in left[as_bytes].tolist()]
        n[as_bytes] = [len(s) for s in spelled]
        ids = np.repeat(left, n)
        if spelled:
            first = (np.cumsum(n) - n)[as_bytes]
            where = np.repeat(first - np.r_[0, np.cumsum(n[as_bytes])[:-1]], n[as_bytes]) + np.arange(n[as_bytes].sum())
            ids[where] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        upto = np.r_[0, np.cumsum(n)][np.searchsorted(places, ends)]  # ids before the end of each word
        k, m = len(self.index), len(words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        if k + m > len(self.starts):
            more = np.zeros(max(m, len(self.starts)), np.int64)
            self.starts, self.counts = np.r_[self.starts, more], np.r_[self.counts, more]
        self.pool[self.used : self.used + len(ids)] = ids
        self.counts[k : k + m] = np.diff(np.r_[0, upto])
        self.starts[k : k + m] = self.used + np.r_[0, upto[:-1]]
        self.used += len(ids)
        self.index.update(zip(words, range(k, k + m)))

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        if len(self.index) > MEMO:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        n = self.counts[which]
        return self.pool[np.repeat(self.starts[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], n

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; number of ids of each text)."""
        total, parts, owner, words, held = np.ones(len(texts), np.int64), [], [], [], 0
        for k, text in enumerate(texts):
            text, at = " " + text.replace(MARK, " ") if text else "", 0
            while at < len(text):
                cut = self.slices.search(text, at + SLICE) if len(text) - at > SLICE else None
                upto = cut.end() if cut else len(text)
                found = self.words.findall(text, at, upto)
                owner.append((k, len(found)))
                words += found
                held += upto - at
                at = upto
                if held >= SLICE or (at == len(text) and k == len(texts) - 1):
                    parts.append(self._count(owner, words, total))
                    owner, words, held = [], [], 0
        if words:
            parts.append(self._count(owner, words, total))
        out = np.full(total.sum(), self.end, np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(total) - 1] = False
        if parts:
            out[inner] = np.concatenate(parts)
        return out, total

    def _count(self, owner: list[tuple[int, int]], words: list[str], total: np.ndarray) -> np.ndarray:
        """The ids of ``words``; their numbers are added to the texts that own them."""
        ids, n = self._block(words)
        upto = np.r_[0, np.cumsum(n)][np.cumsum([m for _, m in owner])]
        np.add.at(total, [k for k, _ in owner], np.diff(np.r_[0, upto]))
        return ids

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ``counts`` ids."""
        n = self.surface_n[ids]
        ends = np.cumsum(n)
        data = self.surface[np.repeat(self.surface_at[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        upto = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        kinds = self.kinds[ids]
        spoken = np.flatnonzero(kinds != CONTROL)
        begins = np.cumsum(counts) - counts
        first = spoken[np.minimum(np.searchsorted(spoken, begins), len(spoken) - 1)] if len(spoken) else begins
        blank = self.blank_first[ids[first]] & (first >= begins) & (first < begins + counts) if len(ids) else np.zeros(len(counts), bool)
        silent = np.flatnonzero((kinds[1:] == CONTROL) & (kinds[:-1] == BYTE)) + 1
        silent = silent[~np.isin(silent + 1, np.cumsum(counts))]  # but the last id of a text
        parted = set(begins[np.searchsorted(begins, silent, "right") - 1].tolist())  # a control id parts the bytes beside it
        out = []
        for a, b, at, n, drop in zip(upto[:-1].tolist(), upto[1:].tolist(), begins.tolist(), counts.tolist(), blank.tolist()):
            try:
                text = data[a:b].decode() if at not in parted else self._decode_slowly(ids[at : at + n].tolist())
            except UnicodeDecodeError:
                text = self._decode_slowly(ids[at : at + n].tolist())
            out.append(text[1:] if drop else text)
        return out

    def _decode_slowly(self, ids: list[int]) -> str:
        """The text of ids whose byte pieces are no whole characters: each such byte is U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, self.end]:
            at = self.surface_at[i]
            piece = self.surface[at : at + self.surface_n[i]].tobytes()
            if self.kinds[i] == BYTE:
                run += piece
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("\ufffd")
                    k = 1
                del run[:k]
            out.append(piece.decode())
        return "".join(out)


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """Read once for each worker."""
    return Vocabulary(model)


def encode_pieces(docs: DataFrame, model: bytes, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ids (array of int, the end id last) and decoded (the text of these ids)."""
    shipped(docs.sparkSession)
    vocabulary(model)  # refuses a model that it can't read, before any task starts
    keep = [c for c in keep if c not in RESULT]
    source = docs.select(F.struct(*keep).alias("_kept"), F.col(text_col).cast("binary").alias("_text"))
    schema = T.StructType([source.schema["_kept"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            upto = np.cumsum(pc.binary_length(batch.column("_text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = (np.flatnonzero(np.diff(upto // SLICE)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                texts = [(t or b"").decode("utf-8", "replace") for t in part.column("_text").to_pylist()]
                ids, counts = vocab.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_kept"), lists, pa.array(vocab.decode(ids, counts), pa.string())], names=schema.names)

    return source.mapInArrow(run, schema).select("_kept.*", *RESULT)


def digest(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what ``encode_pieces`` returns."""
    return found.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
