"""N-gram Jaccard join: prefix filters under several global orders, then exact verification.

A document's set holds 64-bit hashes of its distinct shingles of ``SHINGLE`` words. Documents with
equal sets form a class, known by its smallest row. A global order of shingles ranks them; a set's
prefix under it is the least part of which two sets that link must share a member. So a pair is a
candidate only if its prefixes meet, and under ``ORDERS`` different orders they must meet in each.
The first order puts rare shingles first: rarity comes from counters over all shingles of all
documents, wide in proportion to their number (``COUNTERS_MOST`` at most), of which only the
magnitude is sent to the tasks. The other orders are by hashes. Orders steer the cost, never the result.

*Index.* Prefix members under the first order are dealt to buckets, packed as bytes; a member that
very many documents may have is salted. Members of one set only drop out there, and what remains
are groups of rows by shingle.

*Families.* First each row meets the rows of ``FAMILY_TOKENS`` of its groups, the largest ones,
which near copies have in common. A group gives pairs that span it, fewer than its rows; these
are verified, and components of the links found settle families of any size.

*Rest.* In each group that is left with rows of several components, all pairs of rows of different
components are compared, in blocks where the group is large. Of each pair the sizes must allow a
link; then positions: by the first shingle that they share in the order, no more than what follows
can be common; then parity sketches, whose bits that differ are no more than the members that
differ; then the prefixes under the other orders, which must meet. What passes is verified: the
sets move, and common shingles are counted exactly. All filters are bounds, so no link between
different components is lost, and components are exact. Rows are told apart before they are exchanged:
sketches and texts of rows that are in no pair stay where they are, but for few (``of_pairs``).

Rows are numbered once, in a table written with their texts, so no number changes when a task or
an executor is lost or files are cut anew.
Defined results: a null, empty or blank text has no shingle and links with nothing; fewer words
than ``SHINGLE`` are one shingle; equal rows are linked; a component's id is its smallest id that
is not null; an empty table gives no rows; extra columns are ignored, whatever
their names; a very long text is one set, of 8 bytes a shingle. Memory: one document's set,
one bucket of the index, one group of bounded size, a filter of 16 MB at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, shipped, stored
from .components import components

SHINGLE, PERCENT = 5, 80
#: How many global orders must agree on a candidate.
ORDERS = 3
#: One counter for so many shingles; counters at least and at most; how many are in one row.
PER_COUNTER, COUNTERS_LEAST, COUNTERS_MOST, CHUNK = 32, 1 << 16, 1 << 24, 1 << 14
#: Entries of an index bucket, rows of a salted group, and rows of a block, about.
BUCKET_ENTRIES, GROUP_ROWS, BLOCK_ROWS = 400_000, 1000, 512
#: Bits of the rank by which a prefix member of the other orders is known.
RANK = 32
#: Pairs of one leader that are verified in one go.
LEADER_PAIRS = 1000
#: Bits of the filter of rows for each pair, and in all at least (one bitmap of Spark's) and at most.
PAIR_BITS, FILTER_LEAST, FILTER_MOST = 32, 1 << 15, 1 << 27
#: Bits of a parity sketch at least and at most; a set has twice as many as members, about.
PARITY_LEAST, PARITY_MOST = 512, 1 << 20
#: By how many of its groups a row looks for its family at first, and bytes of a sketch there.
FAMILY_TOKENS, FOLDED = 4, PARITY_LEAST // 8
#: Rarity is told in quarters of a doubling, from this multiple of the counters' mean on.
STEPS, PLAIN = 4, 1.75
#: Odd multipliers: one for each word of a shingle, one for each order.
WORD_FACTORS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD6E8FEB86659FD93 << k)) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(SHINGLE))
ORDER_FACTORS = tuple((0xA24BAED4963EE407 + 0x9FB21C651E98DF26 * k) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(ORDERS))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """Hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [(t or b"").translate(LOWER).split() for t in texts]
    flat = np.fromiter((hashes[w] for ws in words for w in ws), dtype=np.uint64, count=sum(map(len, words)))
    factors = [np.uint64(f) for f in WORD_FACTORS]
    grams = np.zeros(max(0, len(flat) - SHINGLE + 1), dtype=np.uint64)
    for k, f in enumerate(factors):
        grams += flat[k : k + len(grams)] * f
    grams = mixed(grams)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= SHINGLE:
            out.append(np.unique(grams[at : at + n - SHINGLE + 1]))
        elif n:
            part = sum(int(h) * f for h, f in zip(flat[at : at + n], WORD_FACTORS)) + n
            out.append(mixed(np.array([part & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def prefix(shingles: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The members of a set that come first under the first order, in order, as many as a link must meet."""
    n = len(shingles)
    count = n - (PERCENT * n + 99) // 100 + 1
    shift = np.uint64(64 - int(len(rarity)).bit_length() + 1)
    key = (rarity[(shingles >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mixed(shingles * np.uint64(ORDER_FACTORS[0])) >> np.uint64(8))
    first = np.argpartition(key, count - 1)[:count] if count < n else np.arange(n)
    return shingles[first[np.argsort(key[first])]]


def parity(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of members falls to i; a half folds onto the other."""
    size = 1 << min(max((2 * len(shingles) - 1).bit_length(), PARITY_LEAST.bit_length() - 1), PARITY_MOST.bit_length() - 1)
    bits = np.bincount((mixed(shingles) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: bytes) -> bytes:
    """A parity sketch of ``FOLDED`` bytes, which bounds as the whole one does, if less tightly."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype=np.uint64).reshape(-1, FOLDED // 8), axis=0).tobytes()


def heads(shingles: np.ndarray) -> bytes:
    """The prefixes under the orders but the first, each as sorted ranks cut to ``RANK`` bits."""
    n = len(shingles)
    count = n - (PERCENT * n + 99) // 100 + 1
    out = []
    for factor in ORDER_FACTORS[1:]:
        rank = mixed(shingles * np.uint64(factor))
        out.append((np.partition(rank, count - 1)[:count] if count < n else rank) & np.uint64((1 << RANK) - 1))
    return np.concatenate(out).astype(np.uint32).tobytes()


def heads_meet(x: bytes, y: bytes) -> bool:
    """Whether two sets' prefixes share a member under each of the orders but the first."""
    a, b = (np.frombuffer(h, dtype=np.uint32).reshape(ORDERS - 1, -1) for h in (x, y))
    return all(np.isin(p, q).any() for p, q in zip(a, b))


def near_enough(batches):
    """Of the pairs (a, b, nx, ny, px, py, hx, hy), those whose sizes, sketches and prefixes allow a link."""
    for batch in batches:
        a, b, n, m = (batch[c].to_numpy().astype(np.int64) for c in ("a", "b", "nx", "ny"))
        left, right = batch["px"].to_pylist(), batch["py"].to_pylist()
        # a link has 100 * both >= PERCENT * (n + m - both), and n + m - 2 * both members differ
        most = n + m - 2 * common_least(n, m)
        size = np.array([[len(x), len(y)] for x, y in zip(left, right)]).reshape(-1, 2)
        ok = np.zeros(len(a), dtype=bool)
        for x, y in np.unique(size, axis=0):
            at = np.flatnonzero((size[:, 0] == x) & (size[:, 1] == y))
            least = min(x, y)
            folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(side[k] for k in at.tolist()), dtype=np.uint8).reshape(len(at), -1, least), axis=1) for side in (left, right)]
            ok[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64) <= most[at]
        heads_x, heads_y = batch["hx"], batch["hy"]
        for k in np.flatnonzero(ok).tolist():
            ok[k] = heads_meet(heads_x[k].as_py(), heads_y[k].as_py())
        yield a[ok].tolist(), b[ok].tolist()


def salts_of(token: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Into how many groups the rows of each shingle are dealt."""
    shift = np.uint64(64 - len(rarity).bit_length() + 1)
    about = 2.0 ** np.minimum(rarity[(token >> shift).astype(np.int64)] / STEPS, 50)
    return np.maximum(1, about // GROUP_ROWS).astype(np.int64)


def salt_of(token: np.ndarray, row: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The group of a row under a shingle: another one under each, so that rows parted by one meet by the next."""
    return (mixed(mixed(token) ^ row.astype(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)


def common_least(n, m):
    """How many members two sets of these sizes must have in common to link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, n - 1)] == b).sum())
    return 100 * both >= PERCENT * (n + m - both)


def _batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over dicts of lists; ``run`` takes batches and yields lists of columns."""
    fields = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run({n: c for n, c in zip(b.schema.names, b.columns)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    return df.mapInArrow(go, schema)


def _sets(batch: dict, hashes: WordHashes, step: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    rows = batch["_row"].to_pylist()
    for at in range(0, len(rows), step):
        yield from zip(rows[at : at + step], shingle_sets(batch["_text"].slice(at, step).to_pylist(), hashes))


def scanned(docs: DataFrame, counters: int) -> DataFrame:
    """(row, n, one, two, bits, fold, heads): a row's set size, fingerprint, sketches and prefixes; and (-1 - chunk, counts)."""

    def run(batches):
        hashes, counts = WordHashes(), np.zeros(counters, dtype=np.int64)
        shift = np.uint64(64 - counters.bit_length() + 1)
        for batch in batches:
            rows, sizes, one, two, bits, folds, tops = [], [], [], [], [], [], []
            for row, s in _sets(batch, hashes):
                key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
                rows.append(row)
                sizes.append(len(s))
                one.append(key[0])
                two.append(key[1])
                bits.append(parity(s))
                folds.append(folded(bits[-1]))
                tops.append(heads(s) if len(s) else b"")
                np.add.at(counts, (s >> shift).astype(np.int64), 1)
            yield rows, sizes, one, two, bits, folds, tops
        parts = np.minimum(counts, 65_535).astype(np.uint16).reshape(-1, min(CHUNK, counters))
        live = [k for k, p in enumerate(parts) if p.any()]
        yield [-1 - k for k in live], [0] * len(live), [0] * len(live), [0] * len(live), [parts[k].tobytes() for k in live], [b""] * len(live), [b""] * len(live)

    return _batches(docs, run, "row long, n int, one long, two long, bits binary, fold binary, heads binary")


def magnitudes(chunks: DataFrame, counters: int) -> np.ndarray:
    """How often the shingles of each counter occur, in quarters of doublings, one byte each.

    0 stands for all up to ``PLAIN`` times the mean, as those of single shingles do.
    """
    width = min(CHUNK, counters)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, c in zip(batch["row"].to_pylist(), batch["bits"].to_pylist()):
                total[row] = total.get(row, 0) + np.frombuffer(c, dtype=np.uint16).astype(np.int64)
        keys = list(total)
        yield keys, [np.floor(STEPS * np.log2(total[k] + 1)).astype(np.uint8).tobytes() for k in keys]

    out = np.zeros(counters, dtype=np.uint8).reshape(-1, width)
    for r in _batches(chunks.select("row", "bits").repartition("row"), run, "row long, sums binary").collect():  # `counters` bytes
        out[-1 - r["row"]] = np.frombuffer(r["sums"], dtype=np.uint8)
    out = out.ravel()
    mean = float(np.mean(2.0 ** (out / STEPS) - 1))
    return np.where(out <= STEPS * np.log2(PLAIN * max(mean, 1) + 1), 0, out).astype(np.uint8)


def indexed(docs: DataFrame, rarity, buckets: int) -> DataFrame:
    """(token, salts, rows, rests): rows whose prefix has the shingle, if two or more; ascending.

    A rest is how many members of a row's set come from the shingle on, it included. If it is the
    first that two sets share, they share no more than the smaller rest.
    """

    def emit(batches):
        hashes, rare = WordHashes(), rarity.value
        for batch in batches:
            # rows come in no order, as a task may read several files; of equal sets the smallest row stays
            kept = {}
            for row, s in _sets(batch, hashes):
                if len(s) and ((key := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) not in kept or row < kept[key][0]):
                    kept[key] = row, len(s), prefix(s, rare) if key not in kept else kept[key][2]
            tokens, rows, rests = [], [], []
            for row, n, first in kept.values():
                tokens.append(first)
                rows.append(np.full(len(first), row, dtype=np.int64))
                rest = n - np.arange(len(first))
                rests.append(np.where(rest >= common_least(n, n), -rest, rest))
            if not rows:
                continue
            token, row, rest = np.concatenate(tokens), np.concatenate(rows), np.concatenate(rests).astype(np.int32)
            salt = salt_of(token, row, salts_of(token, rare)).astype(np.uint64)
            bucket = (mixed(token + salt * np.uint64(WORD_FACTORS[0])) % np.uint64(buckets)).astype(np.int64)
            base = row >> 32  # numbers of several files may be in a batch, whose upper halves differ
            order = np.lexsort((token, base, bucket))
            bucket, base, token, row, rest = bucket[order], base[order], token[order], row[order], rest[order]
            edges = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (base[1:] != base[:-1]), [True]))).tolist()
            small = (row & 0xFFFFFFFF).astype(np.uint32)
            cut = list(zip(edges, edges[1:]))
            yield [int(bucket[a]) for a, _ in cut], [int(base[a]) << 32 for a, _ in cut], [token[a:b].tobytes() for a, b in cut], [small[a:b].tobytes() for a, b in cut], [rest[a:b].tobytes() for a, b in cut]

    def group(batches):
        rare = rarity.value

        def done(held):
            token, row, rest = (np.concatenate(x) for x in zip(*held))
            salts = salts_of(token, rare)
            salt = salt_of(token, row, salts)
            order = np.lexsort((row, salt, token))
            token, row, salt, salts, rest = token[order], row[order], salt[order], salts[order], rest[order]
            edges = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]), [True])))
            # a pair needs one member whose rest is long enough for a set of its own size
            early = np.add.reduceat((rest < 0).astype(np.int64), edges[:-1]) > 0
            keep = (np.diff(edges) > 1) & early | (salts[edges[:-1]] > 1)
            rest = np.abs(rest)
            begin, end = edges[:-1][keep].tolist(), edges[1:][keep].tolist()
            for at in range(0, len(begin), 20_000):
                a, b = begin[at : at + 20_000], end[at : at + 20_000]
                yield token[a].view(np.int64).tolist(), salts[a].tolist(), [row[x:y].tolist() for x, y in zip(a, b)], [rest[x:y].tolist() for x, y in zip(a, b)]

        held, last = [], None
        for batch in batches:
            for bucket, base, token, row, rest in zip(*(batch[c].to_pylist() for c in ("bucket", "base", "tokens", "rows", "rests"))):
                if bucket != last and held:
                    yield from done(held)
                    held = []
                last = bucket
                held.append((np.frombuffer(token, dtype=np.uint64), np.frombuffer(row, dtype=np.uint32).astype(np.int64) + base, np.frombuffer(rest, dtype=np.int32).astype(np.int64)))
        if held:
            yield from done(held)

    packed = _batches(docs, emit, "bucket long, base long, tokens binary, rows binary, rests binary")
    return _batches(packed.repartition("bucket").sortWithinPartitions("bucket"), group, "token long, salts long, rows array<long>, rests array<long>")


def of_pairs(table: DataFrame, row: str, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` whose number ``row`` is in ``pairs`` (a, b), and few others, told before any row moves.

    A number is known by one bit of its hash, in bitmaps sent to all tasks; so a row too many may stay, but none of a pair
    goes. pairs is read from a table.
    """
    width = 1 << min(max((PAIR_BITS * pairs.count()).bit_length(), FILTER_LEAST.bit_length() - 1), FILTER_MOST.bit_length() - 1)
    bit = lambda number: F.pmod(F.xxhash64(number), F.lit(width))
    numbers = pairs.select(F.explode(F.array("a", "b")).alias("_number"))
    bits = numbers.select(bit("_number").alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))
    own = table.withColumns({"_bucket": F.bitmap_bucket_number(bit(row)), "_at": F.bitmap_bit_position(bit(row))})
    byte = F.expr("cast(conv(hex(substring(_bitmap, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    return own.join(F.broadcast(bits), "_bucket").where(held).select(*table.columns)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows that link. pairs: distinct, already through all filters, read from a table.

    Sets meet by leader ``a``, whose pairs are salted if many; a leader's set goes to each salt.
    """
    many = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_PAIRS).alias("salts")))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    leaders = many.select(F.col("a").alias("_row"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    asks = leaders.unionByName(dealt.select(F.col("b").alias("_row"), "a", "salt", F.lit(1).alias("side")))
    asks = asks.groupBy("_row").agg(F.collect_list(F.struct("a", "salt", "side")).alias("asks"))

    def ship(batches):
        hashes = WordHashes()
        for batch in batches:
            out = [[], [], [], [], []]
            for (row, s), asks in zip(_sets(batch, hashes), batch["asks"].to_pylist()):
                data = s.tobytes()
                for x in asks:
                    for c, v in zip(out, (x["a"], x["salt"], x["side"], row, data)):
                        c.append(v)
                if len(out[0]) > 2000:
                    yield out
                    out = [[], [], [], [], []]
            yield out

    def verify(batches):
        last, own = None, None
        for batch in batches:
            found = [[], []]
            for a, side, row, data in zip(*(batch[c].to_pylist() for c in ("a", "side", "row", "data"))):
                s = np.frombuffer(data, dtype=np.uint64)
                if side == 0:
                    last, own = a, s
                elif last == a and linked(own, s):
                    found[0].append(a)
                    found[1].append(row)
            yield found

    # texts that are asked for meet their asks by a sorted join whatever the sizes, so that cost grows in proportion
    sets = _batches(of_pairs(texts, "_row", pairs).join(asks.hint("merge"), "_row"), ship, "a long, salt long, side int, row long, data binary")
    return _batches(sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "side"), verify, "a long, b long")


def family_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b, rest) that join the rows of each group (token, part) into as few parts as filters allow.

    members: token, part, row, n, rest, fold. Of the pairs that sizes, positions and sketches allow,
    those are taken that span the group with the greatest likeness: each part, a row at first, is
    joined with the one that has the row most like one of its own, until no parts can be joined. So
    a group of m rows gives m - 1 pairs at most, however many of its rows are alike.
    """

    def spanned(rows: list[tuple], out: dict) -> None:
        bits = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
        row, n, rest = np.array([r[:3] for r in rows]).T
        spare = np.full((len(rows), len(rows)), -1, dtype=np.int32)  # how many members may differ more than do
        for k in range(1, len(rows)):
            both, least = np.minimum(rest[:k], rest[k]), common_least(n[:k], n[k])
            ok = np.flatnonzero((100 * np.minimum(n[:k], n[k]) >= PERCENT * np.maximum(n[:k], n[k])) & (both >= least))
            if len(ok):
                spare[k, ok] = spare[ok, k] = n[ok] + n[k] - 2 * least[ok] - np.bitwise_count(bits[ok] ^ bits[k]).sum(axis=1, dtype=np.int64)
        part = np.arange(len(rows))
        while True:
            other = np.where(part[:, None] != part[None, :], spare, -1)
            to = other.argmax(axis=1)
            best = other[np.arange(len(rows)), to]
            order = np.argsort(-best, kind="stable")
            order = order[best[order] >= 0]
            if not len(order):
                return
            _, first = np.unique(part[order], return_index=True)
            for k in order[first].tolist():
                j = int(to[k])
                if part[j] != part[k]:  # not joined by another part's choice
                    a, b = sorted((j, k))
                    pair = int(row[a]), int(row[b])
                    out[pair] = max(int(min(rest[a], rest[b])), out.get(pair, 0))
                    part[part == max(part[a], part[b])] = min(part[a], part[b])

    def run(batches):
        key, held, out = None, [], {}
        for batch in batches:
            for token, part, *x in zip(*(batch[c].to_pylist() for c in ("token", "part", "row", "n", "rest", "fold"))):
                if key != (token, part):
                    if len(held) > 1:
                        spanned(held, out)
                    held, key = [], (token, part)
                    if len(out) > 50_000:
                        yield [p[0] for p in out], [p[1] for p in out], list(out.values())
                        out = {}
                held.append(x)
        if len(held) > 1:
            spanned(held, out)
        yield [p[0] for p in out], [p[1] for p in out], list(out.values())

    return _batches(members.repartition("token", "part").sortWithinPartitions("token", "part", "row"), run, "a long, b long, rest long")


def rest_pairs(members: DataFrame) -> DataFrame:
    """All pairs (a, b, rest) of rows of different components in a group that sizes, positions and sketches allow.

    members: token, row, n, root, rest, fold and _blocks, into how many blocks the group is dealt; block i
    meets block j at the cell (least, greatest) of the two.
    """
    own = members.withColumn("_own", F.pmod(F.xxhash64("row"), "_blocks"))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cells = cells.select("token", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "row", "n", "root", "rest", "fold")

    def done(key: tuple, held: list, out: dict) -> None:
        own, row, n, root, rest = np.array([x[:5] for x in held]).T
        bits = np.frombuffer(b"".join(x[5] for x in held), dtype=np.uint64).reshape(len(held), -1)
        for k in range(len(row) - 1):
            later = slice(k + 1, None)
            both = np.minimum(rest[later], rest[k])
            least = common_least(n[later], n[k])
            ok = (root[later] != root[k]) & (100 * np.minimum(n[later], n[k]) >= PERCENT * np.maximum(n[later], n[k])) & (both >= least)
            if key[1] != key[2]:
                ok &= own[later] != own[k]
            if not ok.any():
                continue
            ok &= np.bitwise_count(bits[later] ^ bits[k]).sum(axis=1, dtype=np.int64) <= n[later] + n[k] - 2 * least
            for x in np.flatnonzero(ok).tolist():
                pair = min(int(row[k]), int(row[k + 1 + x])), max(int(row[k]), int(row[k + 1 + x]))
                out[pair] = max(int(both[x]), out.get(pair, 0))

    def run(batches):
        key, held, out = None, [], {}
        for batch in batches:
            for token, i, j, *x in zip(*(batch[c].to_pylist() for c in ("token", "i", "j", "_own", "row", "n", "root", "rest", "fold"))):
                if key != (token, i, j):
                    if len(held) > 1:
                        done(key, held, out)
                    held, key = [], (token, i, j)
                    if len(out) > 50_000:
                        yield [p[0] for p in out], [p[1] for p in out], list(out.values())
                        out = {}
                held.append(x)
        if len(held) > 1:
            done(key, held, out)
        yield [p[0] for p in out], [p[1] for p in out], list(out.values())

    return _batches(cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j"), run, "a long, b long, rest long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, id, n_shingles, component_id, and the component's first row.

    row_col: a column of ``docs`` that numbers its rows and is read from a table; rows are numbered
    and written here without one.
    """
    spark = shipped(docs.sparkSession)
    rows = numbered(docs, row_col, _id=F.col(id_col), _text=F.col(text_col).cast("binary"))
    texts = rows.select("_row", "_text")
    n_bytes = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shingles = n_bytes // 6 + 1  # about; it sets widths only
    counters = 1 << min(max((shingles // PER_COUNTER).bit_length(), COUNTERS_LEAST.bit_length() - 1), COUNTERS_MOST.bit_length() - 1)
    scan = stored(scanned(texts, counters))
    rarity = spark.sparkContext.broadcast(magnitudes(scan.where("row < 0"), counters))
    sketches = scan.where("row >= 0").select("row", "n", "bits", "fold", "heads")
    first = stored(scan.where("row >= 0 and n > 0").groupBy("one", "two").agg(F.min("row").alias("rep")))
    sets = stored(scan.where("row >= 0").join(first, ["one", "two"], "left").select("row", "n", F.coalesce("rep", "row").alias("rep")))
    groups = stored(indexed(texts, rarity, max(64, shingles // 5 // BUCKET_ENTRIES)))
    # the smallest row of each set is always in the index; its copies need not be compared
    entries = groups.select("token", F.element_at("rows", 1).alias("part"), F.size("rows").alias("many"), F.explode(F.arrays_zip("rows", "rests")).alias("_"))
    entries = entries.select("token", "part", "many", F.col("_.rows").alias("row"), F.col("_.rests").alias("rest"))
    least = F.ceil(F.col("n").cast("long") * (2 * PERCENT) / (100 + PERCENT))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs of rows that may link by sizes, positions, sketches and the prefixes of the other orders."""
        pairs = stored(pairs.groupBy("a", "b").agg(F.max("rest").alias("rest")))
        own = of_pairs(sketches, "row", pairs)
        left, right = (own.select(F.col("row").alias(r), F.col("n").cast("long").alias(f"n{x}"), F.col("bits").alias(f"p{x}"), F.col("heads").alias(f"h{x}")) for r, x in (("a", "x"), ("b", "y")))
        pairs = pairs.join(left, "a").join(right, "b")
        pairs = pairs.where(f"100 * least(nx, ny) >= {PERCENT} * greatest(nx, ny) and {100 + PERCENT} * rest >= {PERCENT} * (nx + ny)")
        return _batches(pairs.select("a", "b", "nx", "ny", "px", "py", "hx", "hy"), near_enough, "a long, b long")

    early = entries.join(sets.where("row = rep").select("row", "n"), "row").where(F.col("rest") >= least)
    order = Window.partitionBy("row").orderBy(F.desc("many"), F.xxhash64("token"), "token")
    picked = early.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= FAMILY_TOKENS).drop("_at")
    tried = stored(near(family_pairs(picked.join(sketches.select("row", "fold"), "row"))))
    joined = components(verified(tried, texts))

    def placed() -> DataFrame:
        """Each row with its representative, size and component so far."""
        return sets.join(joined.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("row", "rep", "n", F.coalesce("root", "rep").alias("root"))

    members = stored(entries.join(placed().where("row = rep"), "row").join(sketches.select("row", "fold"), "row").select("token", "row", "n", "root", "rest", "fold"))
    open_ = members.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_rows"))
    open_ = stored(open_.where("_low <> _high").select("token", F.ceil(F.col("_rows") / BLOCK_ROWS).alias("_blocks")))
    more = stored(near(rest_pairs(members.join(open_, "token"))).join(tried, ["a", "b"], "left_anti"))
    joined = components(joined.unionByName(verified(more, texts)))
    named = stored(placed().join(rows.select(F.col("_row").alias("row"), "_id"), "row").select("row", "_id", "n", "root"))
    smallest = stored(named.groupBy("root").agg(F.min("_id").alias("component_id")))
    return named.join(smallest, "root").select("row", F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("root").alias("first_row"))
