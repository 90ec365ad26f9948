"""Removal of repeated word passages with fixed-block anchors.

A window of ``window`` words is removed wherever its words also start anywhere else. Each text is cut
into non-overlapping reference blocks of (window + 1) / 2 words, so every window has a whole block
inside, whatever its alignment. The index of blocks (hash and count) is probed with every rolling
block-sized run of every text: first through a bit array made from the index, of a size that has a
bound, which only says "maybe" or "no"; a fuller array lets more through and changes no result.

A run that hits away from its own blocks, or at a block that occurs twice, makes the windows around
it candidates. Of the hits inside a candidate window the one of least hash is its anchor: equal windows
have equal anchors at equal places. Consecutive windows of one anchor travel together as one pattern,
equal patterns are merged before any window is looked at, and only patterns that occur once are
compared window by window; the windows that repeat are joined to maximal runs at the end. No pairs are
formed; what a hot passage sends is one row per occurrence and one per distinct surrounding.

Windows and patterns are compared by a 64-bit hash within their anchor, which is 64 bits more: two
unlike windows are taken for one only if both agree. Over the n * n / 2 pairs of a corpus that is a
chance of n * n / 2**129, and of m * m / 2**65 among the m unlike windows around one block (for a block
with 10**8 of them, 1 in 3,700).

Words are runs of anything but space and 0x09 to 0x0D, unchanged. Null texts have no words. Texts of
fewer words than a window keep them all. Repeated rows repeat each other's windows, and what is found
for them is collected once. Documents are told apart by key and text, so repeated or null keys do no
harm. Texts of any length are read whole, by one task each. An empty table gives no rows. Extra columns
are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.bitfilter import MOST_BITS, made
from tarnflow.llm.common import SOLID, Words, cut, mix, prefix, ranges, runs, ship, slices, store, text_name

WINDOW = 35


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """Hash and count of each distinct reference block."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            words = Words(texts, SOLID, lower=False)
            starts = words.window_starts(block)
            own = starts[(starts - words.offsets[words.row[starts]]) % block == 0]
            h = words.windows(own, block)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(per_batch, "h long").groupBy("h").agg(F.count("*").alias("n"))


def _probed(docs: DataFrame, sent, window: int, block: int, with_windows: bool) -> DataFrame:
    """Candidate windows by document: first start, hashes of anchor and pattern, number, and the windows' hashes."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for texts in slices(batches):
            words = Words(texts, SOLID, lower=False)
            n = len(words.start)
            starts = words.window_starts(block)
            h = words.windows(starts, block)
            hit = known.has(h, "once")
            some, at = h[hit], starts[hit]
            own = (at - words.offsets[words.row[at]]) % block == 0
            real = ~own
            real[own] = known.has(some[own], "twice")
            marked = np.zeros(n + 1, np.int64)
            marked[at[real] + 1] = 1
            marked = np.cumsum(marked)
            s = words.window_starts(window)
            s = s[marked[s + window - block + 1] > marked[s]] if len(s) else s
            first = _chosen(at, some, s, window - block + 1, n)
            w = words.windows(s, window)
            fresh = np.ones(len(s), bool)
            fresh[1:] = (first[1:] != first[:-1]) | (np.diff(s) != 1)
            a = np.flatnonzero(fresh)
            b = np.append(a[1:], len(s)) if len(a) else a
            rows = words.row[s[a]] if len(a) else a
            # the windows of a pattern in order make its name
            name = _fold(w, a, b)
            anchor = np.zeros(n, np.uint64)
            anchor[at] = some
            anchor = anchor[first[a]] if len(a) else anchor[:0]
            take = pa.array(rows)
            arrays = [texts.column("doc_id").take(take), texts.column("th").take(take), pa.array(s[a] - words.offsets[rows], pa.int64()), pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), pa.array(b - a, pa.int32())]
            names = ["doc_id", "th", "first", "anchor", "pattern", "k"]
            if with_windows:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(s)), pa.int32()), pa.array(w.view(np.int64))))
                names.append("windows")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, th binary, first long, anchor long, pattern long, k int" + ", windows array<long>" * with_windows
    return docs.select("doc_id", "th", "text").mapInArrow(per_batch, schema)


def _chosen(at: np.ndarray, h: np.ndarray, s: np.ndarray, width: int, n: int) -> np.ndarray:
    """The hit of least hash among the ``width`` places from each start on, the leftmost on ties."""
    if not len(s):
        return s
    least = np.full(n, np.iinfo(np.uint64).max)
    least[at] = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return (np.minimum(least[s], least[s + width - step]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _fold(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(ranges(prefix(values), start, end) + (end - start).astype(np.uint64))


def repeated_windows(docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, th and starts (array of first word, bits of the repeated windows from there on)."""
    if window < 3 or window % 2 == 0 or window > 123:
        raise ValueError("the window must be odd, from 3 to 123 words")
    block = (window + 1) // 2
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(made(cut(_blocks(docs, block)), most_bits))  # most_bits at most
    patterns = store(_probed(docs, sent, window, block, True).groupBy("anchor", "pattern").agg(F.count("*").alias("n"), F.first("windows").alias("windows")))
    counted = patterns.select("anchor", F.explode("windows").alias("w"), "n").groupBy("anchor", "w").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    repeated = cut(counted.where((F.col("n") > 1) & (F.col("least") == 1)).select("anchor", "w"))  # others need no lookup
    lone = patterns.where(F.col("n") == 1).select("anchor", "pattern", F.posexplode("windows").alias("i", "w"))
    one = F.lit(1).cast("long")
    some = lone.join(repeated, ["anchor", "w"]).groupBy("anchor", "pattern").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))
    every = patterns.where(F.col("n") > 1).select("anchor", "pattern", (F.expr("shiftleft(1L, size(windows))") - one).alias("bits"))
    bits = some.unionByName(every)
    at = _probed(docs, sent, window, block, False).join(bits, ["anchor", "pattern"])
    return at.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "bits")).alias("starts"))  # a set: copies of a row find the same


def _spans(starts: list[dict], n_words: int, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that the windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for x in starts:
        first, bits = x["first"], x["bits"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            edge[first + low] += 1
            edge[first + low + window] -= 1
            bits &= bits - 1
    a, b = runs(np.cumsum(edge[:-1]) > 0)
    return list(zip(a.tolist(), b.tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, spans (start, end, ... in words, of removed words) and kept (words joined by a space)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", text_name("text"))
    found = repeated_windows(rows, window, most_bits).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "starts")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["th"] == found["h"]), "left").select("doc_id", "text", "starts")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                n_words, spans, kept = [], [], []
                for text, starts in zip(part.column(1), part.column(2), strict=True):
                    words = text.as_py().encode().split()
                    n_words.append(len(words))
                    gone = _spans(starts.as_py(), len(words), window) if starts.is_valid else []
                    spans.append([v for pair in gone for v in pair])
                    for a, b in reversed(gone):
                        del words[a:b]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(per_batch, f"doc_id {kind}, n_words long, spans array<long>, kept string")


