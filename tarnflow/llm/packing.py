"""Conflict-constrained best-fit packing of texts into training sequences.

``pieces`` turns texts into items: a text of up to ``capacity`` tokens is one, a longer one is divided
at spaces (``Compiled.parts``), so that every piece, taken alone, has the tokens that it is packed by.
Items are dealt to shards of bounded size and each shard is packed longest first. The open bins of a
shard are ordered by residual room; the search starts at the tightest bin that has room and goes on to
its successors until one is compatible. A bin carries bitmaps of its sources (one for those it has, one
for those at their limit) and of its duplicate clusters: an item isn't put where its cluster is already
or its source is at ``per_source`` items. If no bin is compatible a new one opens. The search has no
cut-off, so an item always gets the tightest compatible bin of its shard.

Every row has a number of its own, given before the items are written down; the shard follows from
that, so a hot or missing key, source or cluster is spread over all shards. A shard has about
SHARD_TOKENS tokens and SHARD_ROWS items; texts, if they are asked for, go through it with their items.

A cluster is a near-duplicate class of ``jaccard_join``; texts without words, which have none, are one
cluster if they are the same. Pieces of one text are one cluster as well.

Null source is a source of its own; null text counts as empty; an empty text has length 0 and is packed
as well. Keys may repeat or be null: each row is an item. Ties are broken by key, piece, source and
cluster. Texts of any length are divided in one task each. An empty table gives no rows. Extra columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import ship, slices, store, text_name, together
from tarnflow.llm.jaccard_join import classes
from tarnflow.llm.token_counts import STEP_BYTES, machine

CAPACITY = 4096
PER_SOURCE = 2
SHARD_TOKENS = 1 << 21
SHARD_ROWS = 1 << 14


def pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY, key: str = "doc_id", source: str = "source", text: str = "text", with_text: bool = False) -> DataFrame:
    """row, key, source, cluster, piece, first, last (characters, end exclusive), n_tokens and, if asked
    for, text of each piece, written down once, as ``pack`` reads them twice."""
    ship(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(whole.alias("text"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source")).withColumn("th", text_name("text")).withColumn("row", F.monotonically_increasing_id())

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = machine(model_path)
        for texts in slices(together(batches, STEP_BYTES), limit=2 * STEP_BYTES, keep=True):  # a run is a little more
            values = texts.column("text")
            counts, long = tokens.divided(values, capacity)
            size = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
            long = dict(sorted(long.items()))
            number = np.ones(len(counts), np.int64)
            number[list(long)] = [len(x) for x in long.values()]
            at = np.concatenate([[0], np.cumsum(number)])
            row = np.repeat(np.arange(len(counts)), number)
            first, last, n = np.zeros(at[-1], np.int64), size[row], counts[row]
            for i, found in long.items():
                first[at[i] : at[i + 1]], last[at[i] : at[i + 1]], n[at[i] : at[i + 1]] = np.array(found).T
            take = pa.array(row)
            arrays = [texts.column(c).take(take) for c in ("row", "key", "source", "th")] + [pa.array(x) for x in (np.arange(at[-1]) - at[row], first, last, n)]
            if with_text:
                parts = pa.array([values[i].as_py()[a:b] for i, found in long.items() for a, b, _ in found], values.type)
                place = row.copy()  # of a text that is one piece, else of the piece among those of long texts
                place[np.isin(row, list(long))] = len(counts) + np.arange(len(parts))
                arrays.append(pa.concat_arrays([values, parts]).take(pa.array(place)))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["row", "key", "source", "th", "piece", "first", "last", "n_tokens", *["text"] * with_text]
    schema = f"row long, key {dict(rows.dtypes)['key']}, source string, th binary, piece long, first long, last long, n_tokens long" + ", text string" * with_text
    found = store(rows.mapInArrow(per_batch, schema))
    near = classes(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).where("class_node IS NOT NULL").groupBy("th").agg(F.first("class_node").alias("class_node"))
    return store(found.join(near, "th", "left").withColumn("cluster", F.coalesce("class_node", "th")).drop("th", "class_node"))


def best_fit(items: Iterable[tuple[int, int, int | None]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each item (length, source number, cluster number or None) in the given order."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    seen: list[int] = []  # bitmaps by bin: sources that it has
    full: list[int] = []  # sources at their limit
    clusters: list[int] = []
    counts: dict[tuple[int, int], int] = {}
    placed = []
    for length, source, cluster in items:
        if length > capacity:
            raise ValueError("an item is longer than a bin")
        bit, group = 1 << source, 0 if cluster is None else 1 << cluster
        at = bisect_left(order, (length, -1))
        while at < len(order):
            b = order[at][1]
            if not (full[b] & bit or clusters[b] & group):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(seen)
            seen.append(0)
            full.append(0)
            clusters.append(0)
        placed.append((b, capacity - residual))
        clusters[b] |= group
        if per_source == 1:
            full[b] |= bit
        elif seen[b] & bit:
            counts[b, source] = counts.get((b, source), 1) + 1
            if counts[b, source] >= per_source:
                full[b] |= bit
        seen[b] |= bit
        insort(order, (residual - length, b))
    return placed


def packed_shard(items: pa.Table, capacity: int, per_source: int) -> pa.Table:
    """The items of one shard, longest first, with the number of their bin and their start in it."""
    order = [("n_tokens", "descending"), *((c, "ascending") for c in ("key", "piece", "source", "cluster"))]
    items = items.sort_by(order)
    source = items["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()
    # a bit only for clusters that this shard has more than once
    cluster = items["cluster"].combine_chunks().dictionary_encode()
    times = np.bincount(cluster.indices.fill_null(0).to_numpy(), cluster.indices.is_valid().to_numpy(zero_copy_only=False), len(cluster.dictionary) + 1)
    often = np.flatnonzero(times > 1)
    bit = dict(zip(often.tolist(), range(len(often)), strict=True))
    placed = best_fit(zip(items["n_tokens"].to_pylist(), source, [bit.get(c) for c in cluster.indices.to_pylist()], strict=True), capacity, per_source)
    return items.append_column("number", pa.array([b for b, _ in placed], pa.int64())).append_column("start", pa.array([s for _, s in placed], pa.int64()))


def pack(items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, as_bins: bool = False, shard_rows: int = SHARD_ROWS, key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, first, last, n_tokens, bin (text), start in the bin and text, if items have it.

    With ``as_bins`` one row per bin: n_pieces, used (tokens), fill and its pieces in order.
    """
    ship(items.sparkSession)
    kinds = dict(items.dtypes)
    rows, tokens = items.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = max(1, math.ceil(tokens / SHARD_TOKENS), math.ceil(rows / shard_rows))
    own = ["key", "piece", "first", "last", "n_tokens"]
    more = ["text"] if "text" in kinds else []
    dealt = items.select(*own, "source", "cluster", *more, F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))

    def solve(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py() if len(table) else 0
        found = packed_shard(table, capacity, per_source)
        if not as_bins:
            names = pa.array([f"{shard}-{b}" for b in found["number"].to_pylist()], pa.string())
            return found.append_column("bin", names).select([*own, "bin", "start", *more])
        found = found.sort_by([("number", "ascending"), ("start", "ascending"), ("n_tokens", "ascending")]).combine_chunks()
        number = found["number"].to_numpy()
        at = np.flatnonzero(np.diff(number, prepend=-1))
        used = np.add.reduceat(found["n_tokens"].to_numpy(), at) if len(at) else np.zeros(0, np.int64)
        fields = ["start", *own, *more]
        columns = [found[c].chunk(0) if found[c].num_chunks else pa.array([], found[c].type) for c in fields]
        struct = pa.StructArray.from_arrays(columns, names=fields)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(number)), pa.int32()), struct)
        names = pa.array([f"{shard}-{b}" for b in number[at].tolist()], pa.string())
        return pa.table({"bin": names, "n_pieces": pa.array(np.diff(np.append(at, len(number))), pa.int64()), "used": pa.array(used, pa.int64()), "fill": pa.array(used / capacity, pa.float64()), "pieces": lists})

    piece = ", ".join(f"{c} {kinds[c]}" for c in own)
    text = ", text string" * len(more)
    inner = "start: bigint, " + ", ".join(f"{c}: {kinds[c]}" for c in [*own, *more])
    schema = f"bin string, n_pieces long, used long, fill double, pieces array<struct<{inner}>>" if as_bins else f"{piece}, bin string, start long{text}"
    packed = dealt.groupBy("shard").applyInArrow(solve, schema)
    return packed if as_bins else packed.withColumnRenamed("key", key)
