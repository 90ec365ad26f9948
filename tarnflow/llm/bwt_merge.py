"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte is removed if a ``length``-byte string covers it that also starts anywhere else.

Distribution. Every ``length``-byte window has an anchor: the GRAM bytes inside it with the smallest
hash, leftmost on ties, so equal windows have equal anchors at equal places. Anchors are counted over
the corpus; a bit array of those that occur twice (of a size that has a bound) picks the windows that
can repeat at all. Consecutive windows of one anchor form a fragment. Equal fragments are one from
then on, with a number of occurrences; one copy of each is sent (a second bit array picks it), and the
fragments of an anchor meet in one task.

Merging. The fragments of a task are dealt to shards. A shard's Burrows-Wheeler transform is over
symbols of ``length / ROUNDS`` bytes taken at that stride from every offset, so that ROUNDS symbols
are one window; symbols that occur once in the task end strings, as no window across them repeats.
Shard transforms are merged by interleave refinement (``merge``): starting from the shards one after
the other, each round reads the interleaved transforms in order and deals their entries to the buckets
of their symbols, stably. After h rounds the interleave is sorted by the first h symbols, and an entry
opens a new block where its symbol or its follower's block is new: blocks are the common prefixes of h
symbols. After ROUNDS rounds the blocks whose members occur twice or more, all told, are the repeated
intervals; every removed byte is read from them. Suffixes of different shards are never compared or
sorted again.

Anchors with more than ``hot`` distinct fragments (the surroundings of a passage that very many
texts share) would be too much for a task. Their fragments are shards of their own, spread over all
tasks, and blocks are named by a hash of (symbols so far) instead of a rank, so that the last round's
blocks are counted by one shuffle with partial aggregation. Nothing is left out, and the result is the
same on either side of ``hot``.

Fragments are told apart by 128 bits, and so are the blocks of hot anchors: over n of them two unlike
ones agree with a chance of n * n / 2**129 (at 10**14, 1 in 68 billion). Symbols of a task are compared
by 128 bits as well. Anchors are only ever a way to bring fragments
together; two that agree by chance do no harm.

Null text is empty; texts shorter than ``length`` keep all bytes. Repeated rows repeat each other, and
what is found for them is collected once. Documents are told apart by key and text, so repeated or null
keys do no harm. Texts of any length are read whole, by one task each. An empty table gives no rows.
Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tarnflow.llm.bitfilter import MOST_BITS, made
from tarnflow.llm.common import Texts, byte_prefix, cut, mix, powers_down, ranges, runs, ship, slices, store, text_name

LENGTH, GRAM, ROUNDS = 200, 32, 5
#: Bytes of fragments merged at a time, bytes in a shard, and distinct fragments of an anchor at most.
BUCKET_BYTES, SHARD_BYTES, HOT = 1 << 17, 1 << 15, 1 << 14
#: log2 of the cells in which a task counts symbols; fewer cells than symbols only prune less.
MOST_CELLS = 22
#: Text bytes of one step over a batch: its arrays stay in the processor's cache.
STEP_BYTES = 1 << 18
#: Hot anchors that are broadcast at most (8 MB); beyond, they are joined.
MOST_HOT = 1_000_000


# ---------------------------------------------------------------- transforms


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of small non-negative numbers, 16 bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    rest = values >> 16
    while rest.any():
        order = order[np.argsort((rest[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        rest = rest >> 16
    return order


def _dense(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal columns, of rows that ``order`` sorts."""
    new = np.zeros(len(order), bool)
    for c in columns:
        sorted_ = c[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class ShardBwt:
    """The transform of some strings: per suffix in order, the symbol before it and its place.

    ``symbols`` are numbers from 1; ``after`` gives the place of each one's follower, -1 at the end of
    a string. The end of a string is a suffix too, and the symbol 0.
    """

    def __init__(self, symbols: np.ndarray, after: np.ndarray, rounds: int):
        n = len(symbols)
        rank = symbols
        jump = after
        depth = 1
        while depth < rounds:  # ranks by doubling the number of symbols, ends first
            if depth * 2 > rounds:  # a shorter jump reaches the last of them
                jump = after.copy()
                for _ in range(rounds - depth - 1):
                    jump = np.where(jump >= 0, after[jump], -1)
            second = np.where(jump >= 0, rank[jump], 0)
            order = stable_order(second)
            order = order[stable_order(rank[order])]
            rank = _dense(order, rank, second)
            jump = np.where(jump >= 0, jump[jump], -1)
            depth = min(depth * 2, rounds)
        order = stable_order(rank)
        before = np.zeros(n, np.int64)
        has = after >= 0
        before[after[has]] = symbols[has]
        ends = np.flatnonzero(~has)  # each string's last symbol comes before its end
        self.bwt = np.concatenate([symbols[ends], before[order]])
        self.place = np.concatenate([np.full(len(ends), -1), order])
        self.n_ends = len(ends)


def merge(shards: list[ShardBwt], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave after ``rounds`` rounds: shard, number within the shard, and block of each entry."""
    sizes = [len(s.bwt) for s in shards]
    source = np.repeat(np.arange(len(shards)), sizes)
    bwt = [s.bwt for s in shards]
    total = sum(s.n_ends for s in shards)
    block = np.zeros(len(source), np.int64)
    for _ in range(rounds):
        symbol = np.empty(len(source), np.int64)
        for k, b in enumerate(bwt):
            symbol[source == k] = b
        deal = stable_order(symbol)
        source, symbol, before = source[deal], symbol[deal], block[deal]
        new = np.ones(len(source), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        new[:total] = True  # each end is its own
        block = np.cumsum(new)
    within = np.empty(len(source), np.int64)
    for k, size in enumerate(sizes):
        within[source == k] = np.arange(size)
    return source, within, block


def _viable(h: np.ndarray, at: np.ndarray, stops: np.ndarray, times: np.ndarray, stride: int, rounds: int) -> np.ndarray:
    """Flags of the symbols that are part of a window all of whose symbols may occur twice.

    Symbols are counted, ``times`` each, in a table by part of their hash; one alone in its cell occurs once.
    """
    bits = min(max(10, int(len(h) * 4).bit_length()), MOST_CELLS)
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    twice = np.bincount(cell, times, 1 << bits)[cell] > 1
    n = len(h)
    reach = (rounds - 1) * stride
    if n <= reach:
        return np.zeros(n, bool)
    start = twice[: n - reach].copy()
    for k in range(1, rounds):
        start &= twice[k * stride : n - reach + k * stride]
    start &= at[: n - reach] + reach < stops[: n - reach]
    out = np.zeros(n, bool)
    for k in range(rounds):
        out[k * stride : n - reach + k * stride] |= start
    return out


def repeated_starts(fragments: list[bytes], length: int = LENGTH, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES, times: list[int] | None = None) -> list[np.ndarray]:
    """Per fragment a flag for each start of a ``length``-byte string: does it start anywhere else here?

    ``times`` says how often each fragment occurs; once if it isn't given.
    """
    stride = length // rounds
    sizes = np.array([len(f) for f in fragments])
    times = np.minimum(np.ones(len(fragments)) if times is None else np.array(times), 2.0)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(at[-1] + 1, bool)
    data = np.frombuffer(b"".join(fragments), np.uint8)
    n = len(data) - stride + 1
    if n > 0:
        sums = byte_prefix(data)
        h = mix((sums[stride:] - sums[:n]) * powers_down(n))
        stops = np.repeat(at[1:] - stride + 1, sizes)[:n]  # no symbol goes across fragments
        kept = np.flatnonzero(_viable(h, np.arange(n), stops, np.repeat(times, sizes)[:n], stride, rounds))
        if len(kept):
            more = byte_prefix(data, other=True)
            other = mix((more[kept + stride] - more[kept]) * powers_down(n)[kept])
            _mark(flags, kept, _numbered(h[kept], other), at, times, stride, rounds, shard_bytes)
    return [flags[a : a + max(0, size - length + 1)] for a, size in zip(at.tolist(), sizes.tolist(), strict=False)]


def _numbered(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers from 1 of symbols by their two hashes; the first alone decides unless it takes two for one."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], other[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((other, h))
        return _dense(order, h, other)
    return _dense(order, h)


def _mark(flags: np.ndarray, kept: np.ndarray, symbols: np.ndarray, at: np.ndarray, times: np.ndarray, stride: int, rounds: int, shard_bytes: int) -> None:
    """Sets the flags of the places whose block after all rounds has members that occur twice or more."""
    owner = np.searchsorted(at, kept, side="right") - 1
    number = np.full(len(flags) + stride, -1)
    number[kept] = np.arange(len(kept))
    after = number[kept + stride]
    after = np.where((after >= 0) & (owner[after] == owner), after, -1)
    edges = [0]
    while edges[-1] < len(kept):  # shards hold whole fragments
        first = owner[edges[-1]]
        last = max(int(np.searchsorted(at, at[first] + shard_bytes, side="right")) - 1, int(first) + 1)
        edges.append(int(np.searchsorted(owner, last)))
    shards = [ShardBwt(symbols[a:b], np.where(after[a:b] >= 0, after[a:b] - a, -1), rounds) for a, b in zip(edges, edges[1:], strict=False)]
    source, within, block = merge(shards, rounds)
    occurs = np.ones(len(block))
    for k, (shard, base) in enumerate(zip(shards, edges, strict=False)):
        place = shard.place[within[source == k]]
        occurs[source == k] = np.where(place >= 0, times[owner[base + np.maximum(place, 0)]], 1)
    twice = np.bincount(block, occurs)[block] > 1
    for k, (shard, base) in enumerate(zip(shards, edges, strict=False)):
        place = shard.place[within[twice & (source == k)]]
        flags[kept[base + place[place >= 0]]] = True


# ---------------------------------------------------------------- anchors and fragments


def anchors(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor of each, and the byte prefix sums of the texts."""
    sums = byte_prefix(texts.bytes)
    n = len(texts.bytes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sums
    h = sums[gram:] - sums[:-gram]
    h *= powers_down(len(h))
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)
    width = length - gram + 1  # grams in a window
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < width:
        h = np.minimum(h[: n - length + 1], h[width - step : n - length + 1 + width - step])
    inside = np.zeros(n - length + 1, bool)
    for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
        inside[a : max(a, b - length + 1)] = True
    starts = np.flatnonzero(inside)
    return starts, (h[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64), sums


def _keys(sums: np.ndarray, anchor: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of anchors; mixed again, as anchors are chosen for small hashes."""
    return mix(mix(ranges(sums, anchor, anchor + gram)) ^ np.uint64(0x2545F4914F6CDD1D))


def _counted(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches, limit=STEP_BYTES):
            _, anchor, sums = anchors(texts, length, gram)
            own = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])] if len(anchor) else anchor
            yield pa.RecordBatch.from_arrays([pa.array(_keys(sums, own, gram).view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(per_batch, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def _fragments(docs: DataFrame, sent, length: int, gram: int, wanted=None) -> DataFrame:
    """doc_id, th, first (byte of the first window), k (windows), pattern, key, copy (hash of the place).

    With ``wanted``, an array of copies: key, pattern and bytes of those.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for texts in slices(batches, limit=STEP_BYTES):
            starts, anchor, sums = anchors(texts, length, gram)
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
            a = np.flatnonzero(fresh)
            k = np.diff(np.append(a, len(anchor)))
            key = _keys(sums, anchor[a], gram)
            live = known.has(key, "twice")
            a, k, key = a[live], k[live], key[live]
            begin = starts[a]
            stop = begin + k + length - 1
            rows = np.searchsorted(texts.offsets, begin, side="right") - 1
            first = begin - texts.offsets[rows]
            th = np.frombuffer(b"".join(texts.column("th").to_pylist()), np.uint64)[::2]
            copy = mix(key ^ mix(th[rows] + first.astype(np.uint64)))
            raw = texts.bytes.tobytes()
            if wanted is not None:
                chosen = wanted.value.has(copy, "once")
                data = [raw[x:y] for x, y in zip(begin[chosen].tolist(), stop[chosen].tolist(), strict=True)]
                arrays = [pa.array(key[chosen].view(np.int64)), pa.array([xxh3_128_digest(x) for x in data], pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "pattern", "bytes"])
                continue
            pattern = [xxh3_128_digest(raw[x:y]) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
            take = pa.array(rows)
            arrays = [texts.column("doc_id").take(take), texts.column("th").take(take), pa.array(first, pa.int64()), pa.array(k, pa.int32()), pa.array(pattern, pa.binary())]
            arrays += [pa.array(x.view(np.int64)) for x in (key, copy)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "first", "k", "pattern", "key", "copy"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = "key long, pattern binary, bytes binary" if wanted is not None else f"doc_id {kind}, th binary, first long, k int, pattern binary, key long, copy long"
    return docs.select("doc_id", "th", "text").mapInArrow(per_batch, schema)


def _flag_runs(flags: np.ndarray) -> list[int]:
    a, b = runs(flags)
    return np.stack([a, b], 1).ravel().tolist()


def _merged(cold: DataFrame, length: int, rounds: int) -> DataFrame:
    """pattern, starts (start, end, ... of repeated windows) of fragments.

    ``cold`` has, for each pattern, a row with its number (n) and one or more with its bytes.
    """

    def solve(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_starts([r[2] for r in rows], length, rounds, times=[r[1] for r in rows])
        out = [(r[0], _flag_runs(f)) for r, f in zip(rows, flags, strict=True) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([s for _, s in out], pa.list_(pa.int32()))], names=["pattern", "starts"])

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple[bytes, int, bytes]] = []
        size = 0
        numbers: dict[bytes, int] = {}
        group: dict[bytes, bytes] = {}
        last = None

        def close() -> None:
            nonlocal size
            rows = [(p, numbers[p], x) for p, x in group.items() if p in numbers]
            bucket.extend(rows)
            size += sum(len(r[2]) for r in rows)

        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                for key, pattern, n, data in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if key != last:
                        close()
                        numbers, group, last = {}, {}, key
                        if size >= BUCKET_BYTES:
                            yield solve(bucket)
                            bucket, size = [], 0
                    if data is None:
                        numbers[pattern] = n
                    else:
                        group[pattern] = data
        close()
        if bucket:
            yield solve(bucket)

    dealt = cold.select("key", "pattern", "n", "bytes").repartition("key").sortWithinPartitions("key", "pattern")
    return dealt.mapInArrow(per_partition, "pattern binary, starts array<int>")


def _counted_blocks(hot: DataFrame, length: int, rounds: int) -> DataFrame:
    """The same for fragments (pattern, n, bytes) of hot anchors: blocks named by hashes, counted over all tasks."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = length // rounds
        for texts in slices(batches, "bytes"):
            size = np.maximum(np.diff(texts.offsets) - length + 1, 0)
            offsets = np.concatenate([[0], np.cumsum(size)])
            row = np.repeat(np.arange(texts.n), size)
            start = np.arange(len(row)) - offsets[row] + texts.offsets[row]
            names = []
            for sums in (byte_prefix(texts.bytes), byte_prefix(texts.bytes, other=True)):
                block = np.zeros(len(start), np.uint64)
                for k in reversed(range(rounds)):  # each round puts one symbol before the block of its follower
                    block = mix(block * np.uint64(0x9E3779B97F4A7C15) + mix(ranges(sums, start + k * stride, start + (k + 1) * stride)))
                names.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(block.view(np.int64))))
            yield pa.RecordBatch.from_arrays([texts.column("pattern"), texts.column("n"), *names], names=["pattern", "n", "v", "w"])

    blocks = hot.select("pattern", "n", "bytes").mapInArrow(per_batch, "pattern binary, n long, v array<long>, w array<long>")
    entries = blocks.select("pattern", "n", F.posexplode(F.arrays_zip("v", "w")).alias("i", "b")).select("pattern", "n", "i", "b.v", "b.w")
    counted = entries.groupBy("v", "w").agg(F.sum("n").alias("n"))
    repeated = cut(counted.where(F.col("n") > 1).select("v", "w"))
    found = entries.join(repeated, ["v", "w"]).groupBy("pattern").agg(F.collect_list("i").alias("at"))
    return found.select("pattern", F.flatten(F.transform("at", lambda i: F.array(i, i + 1))).alias("starts"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rounds: int = ROUNDS, most_bits: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, th and found: array of (first, starts) with the starts of repeated windows from ``first`` on."""
    if length % rounds or gram > length // 2 or length // rounds < 2:
        raise ValueError("the length must be a multiple of the rounds and at least twice the gram")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(made(cut(_counted(docs, length, gram)), most_bits, ("twice",)))  # most_bits at most
    places = _fragments(docs, sent, length, gram)
    patterns = store(places.groupBy("key", "pattern").agg(F.count("*").alias("n"), F.min("copy").alias("copy")))
    shared = cut(patterns.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("all")).where(F.col("all") > 1).select("key", "c"))
    needed = cut(patterns.join(shared, "key").select("key", "pattern", "n", "copy", "c"))
    wanted = spark.sparkContext.broadcast(made(cut(needed.select(F.col("copy").alias("h"), F.lit(1).cast("long").alias("n")).distinct()), most_bits, ("once",)))
    copies = _fragments(docs, sent, length, gram, wanted)
    crowded = shared.where(F.col("c") > hot).select("key")
    n_hot = crowded.count()
    numbers = needed.where(F.col("c") <= hot).select("key", "pattern", "n", F.lit(None).cast("binary").alias("bytes"))
    if n_hot:
        crowded = F.broadcast(crowded) if n_hot <= MOST_HOT else crowded
        many = copies.join(crowded, "key", "left_semi").dropDuplicates(["pattern"]).join(needed.select("pattern", "n"), "pattern")
        copies = copies.join(crowded, "key", "left_anti")
    starts = _merged(numbers.unionByName(copies.withColumn("n", F.lit(None).cast("long"))), length, rounds)
    if n_hot:
        starts = starts.unionByName(_counted_blocks(store(many.select("pattern", "n", "bytes")), length, rounds))
    at = places.select("doc_id", "th", "first", "pattern").join(store(starts), "pattern")
    return at.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "starts")).alias("found"))  # a set: copies of a row find the same


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rounds: int = ROUNDS, most_bits: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (start, end, ... of the removed runs, in bytes) and kept (binary)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", text_name("text"))
    found = repeated_spans(rows, length, gram, rounds, most_bits, hot).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "found")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["th"] == found["h"]), "left").select("doc_id", "text", "found")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n_bytes, spans, kept = [], [], []
                for text, found in zip(part.column(1), part.column(2), strict=True):
                    data = text.as_py().encode()
                    n_bytes.append(len(data))
                    gone: list[tuple[int, int]] = []
                    for x in sorted(found.as_py() or [], key=lambda x: x["first"]):
                        s = x["starts"]
                        for a, b in zip(s[::2], s[1::2], strict=True):
                            a, b = x["first"] + a, x["first"] + b - 1 + length
                            if gone and a <= gone[-1][1]:
                                gone[-1] = (gone[-1][0], max(b, gone[-1][1]))
                            else:
                                gone.append((a, b))
                    spans.append([v for pair in gone for v in pair])
                    edges = [0, *spans[-1], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(per_batch, f"doc_id {kind}, n_bytes long, spans array<long>, kept binary")
