"""Near-duplicate classes: n-gram Jaccard join with Bayesian pruning of candidates.

A document's set is its runs of five words (A to Z lowered; fewer words: all of them as one). Texts of
the same words in the same order are one node from then on, with a number of copies, so copies cost
nothing and lose no link.

1. Each node gets PERMUTATIONS MinHash values. Nodes that agree in all ROWS values of one of the BANDS
   bands are candidates; a pair at the threshold is missed with a chance of 3 in a million.
2. In each bucket MinHash values are compared STEP by STEP: a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold, given the
   agreements so far, falls below TOLERANCE. What is left names candidate groups, as the edges of a
   spanning forest, never as pairs.
3. The rest is verified exactly: in each connected candidate group all pairs' set intersections are
   counted, and a link is a similarity of ``threshold`` or more.

Buckets and groups of any size are dealt to tasks as pairs of blocks. A block of signatures has BLOCK
members (2.5 MB) on average; a block of sets has SET_BLOCK members and SET_BYTES bytes of sets on
average, or one set that is larger. A group of n members is thus sent n / BLOCK times over, which is
less work than its n * n / 2 comparisons, all of which the number of links asks for. Tasks return a
row per member (its links) and spanning edges. Classes are the connected components of the links.

Names of nodes and of texts have 128 bits: among n unlike texts two share a name with a chance of
n * n / 2**129. Shingles have 64 bits, and are compared only within a pair.

Null and empty texts, and texts without words, have no set: they are a class of their own each, with
no links. Repeated rows are copies of each other. The class id is the least doc_id of the class
(null ids come last). Texts of any length are read whole; a task holds one text's words at least. An
empty table gives no rows. Extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``,
whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.bitfilter import made
from tarnflow.llm.common import Texts, Words, cut, mix, prefix, ranges, ship, slices, store, text_name, together
from tarnflow.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 5, 32, 1e-6
PERMUTATIONS = BANDS * ROWS
#: Members of a block of signatures; members and bytes of a block of sets.
BLOCK, SET_BLOCK, SET_BYTES = 8192, 512, 1 << 25
#: Bits of a MinHash value that are kept: unlike values agree in them with a chance of 1 in 65,536.
KEPT = np.uint16

_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = (_SEEDS[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (_SEEDS[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


class Shingles:
    """The shingles of some texts: hashes in order of the rows, ``offsets`` of the rows, and row names."""

    def __init__(self, texts: Texts, size: int = SHINGLE):
        self.words = words = Words(texts)
        count = np.diff(words.offsets)
        starts = words.window_starts(size)
        self.hash = words.windows(starts, size)
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):  # all of their words are one shingle
            short = np.concatenate([words.windows(words.offsets[few[count[few] == k]], k) for k in range(1, size)])
            row = np.concatenate([few[count[few] == k] for k in range(1, size)])
            order = np.argsort(row)
            place = np.searchsorted(starts, words.offsets[row[order]])
            self.hash = np.insert(self.hash, place, short[order])
        self.offsets = np.concatenate([[0], np.cumsum(np.where(count < size, count > 0, count - size + 1))])
        self.full = np.flatnonzero(count > 0)

    def names(self) -> list[bytes | None]:
        """A 128-bit name of the words of each row in order; None for no words."""
        out: list[bytes | None] = [None] * (len(self.offsets) - 1)
        if len(self.full):
            at, end = self.words.offsets[:-1][self.full], self.words.offsets[1:][self.full]
            size = (end - at).astype(np.uint64)
            other = prefix(mix(self.words.hash ^ np.uint64(0x5851F42D4C957F2D)))
            pair = np.stack([mix(ranges(prefix(self.words.hash), at, end) + size), mix(ranges(other, at, end) ^ size)], 1)
            for i, name in zip(self.full.tolist(), pair, strict=True):
                out[i] = name.tobytes()
        return out

    def signatures(self, permutations: int = PERMUTATIONS) -> np.ndarray:
        """MinHash values of the rows that have words."""
        x = (self.hash >> np.uint64(32)).astype(np.uint32)
        out = np.empty((permutations, len(self.full)), np.uint32)
        if len(self.full):
            y, at = np.empty_like(x), self.offsets[:-1][self.full]
            for k in range(permutations):
                np.bitwise_xor(x, _FLIP[k], out=y)
                np.multiply(y, _TIMES[k], out=y)
                np.minimum.reduceat(y, at, out=out[k])
        return np.ascontiguousarray(_spread(out).astype(KEPT).T)

    def set_of(self, row: int) -> np.ndarray:
        """The distinct shingles of a row, ascending."""
        return np.unique(self.hash[self.offsets[row] : self.offsets[row + 1]])


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words that brings high bits down, as minima have few high bits set."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def least_agreements(threshold: float, tolerance: float, step: int = STEP, most: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(values compared, agreements below which a pair is dropped).

    With a uniform prior P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(step, most, step), most]:
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


class Forest:
    """Groups of the numbers below n that pairs connect; the group's label is its least number."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def connect(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (lower := self.label[self.label])).any():
                self.label = lower

    def edges(self, names: list[bytes]) -> list[tuple[bytes, bytes]]:
        """An edge from each name to that of its label, but for labels themselves."""
        return [(names[x], names[self.label[x]]) for x in np.flatnonzero(self.label != np.arange(len(names))).tolist()]


def surviving(left: np.ndarray, right: np.ndarray | None, limits: list[tuple[int, int]]) -> Forest:
    """What the pairs that no step drops connect: pairs within ``left``, or between the two.

    ``right`` is numbered after ``left``. Pairs that are connected already are not looked at, so a
    bucket of like members costs little more than its size.
    """
    other, base = (left, 0) if right is None else (right, len(left))
    forest = Forest(base + len(other))
    for low in range(0, len(left), 64):
        some = left[low : low + 64]
        row = low + np.arange(len(some))
        apart = forest.label[row][:, None] != forest.label[base:][None, :]
        if right is None:
            apart &= np.arange(len(left))[None, :] > row[:, None]
        i, j = np.nonzero(apart)
        agree = np.zeros(len(i), np.int16)
        at = 0
        for n, least in limits:
            agree = agree + (some[i, at:n] == other[j, at:n]).sum(1, dtype=np.int16)
            keep = agree >= least
            i, j, agree, at = i[keep], j[keep], agree[keep], n
            if not len(i):
                break
        forest.connect(i + low, j + base)
    return forest


def intersections(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Sizes of the pairwise intersections: of all sets, or of the first ``split`` with the others."""
    sizes = [len(s) for s in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = (len(sets), 0) if split is None else (split, split)
    out = np.zeros((a, len(sets) - b), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[x:y], column[x:y] - low] = 1
        out += m[:a] @ m[b:].T
    return out.astype(np.int64)


# ---------------------------------------------------------------- stages


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, node (null: no set), sig, size (shingles)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            found = Shingles(texts)
            nodes = found.names()
            sig = iter(found.signatures())
            sigs = [None if node is None else next(sig).tobytes() for node in nodes]
            sizes = np.diff(found.offsets)
            yield pa.RecordBatch.from_arrays([texts.column("doc_id"), texts.column("th"), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "th", "node", "sig", "size"])

    return docs.mapInArrow(per_batch, f"doc_id {dict(docs.dtypes)['doc_id']}, th binary, node binary, sig binary, size long")


def _bands(nodes: DataFrame, sent=None) -> DataFrame:
    """node, bucket: one row per band, with ``sent`` of those buckets that may be in its filter."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in together(batches, 1 << 20):
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), KEPT).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(salt, sig.shape[:2])
            for k in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            h = np.ascontiguousarray(h).ravel()
            live = np.ones(len(h), bool) if sent is None else sent.value.has(h, "once")
            offsets = np.concatenate([[0], np.cumsum(live.reshape(-1, BANDS).sum(1))])
            arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[live].view(np.int64)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "buckets"])

    return nodes.select("node", "sig").mapInArrow(per_batch, "node binary, buckets array<long>").select("node", F.explode("buckets").alias("bucket"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, c: members of each bucket of two or more, once per set of members."""
    bands = _bands(nodes)
    print_of = F.xxhash64("node")
    live = bands.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(print_of % (1 << 40)).alias("p"), F.bit_xor(print_of).alias("x")).where(F.col("c") > 1)
    once = cut(live.groupBy("c", "p", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "c"))
    index = once.select(F.col("bucket").alias("h"), F.lit(1).cast("long").alias("n"))
    sent = nodes.sparkSession.sparkContext.broadcast(made(index, arrays=("once",)))  # MOST_BITS at most
    return _bands(nodes, sent).join(once, "bucket")


def _block_pairs(members: DataFrame, group: str, blocks: Column) -> DataFrame:
    """A row per member and task: tasks are the pairs a <= b of a group's blocks; side 0 is block a."""
    n = F.greatest(F.ceil(blocks), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(group, "node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"))


def _by_task(rows: DataFrame, keys: list[str], solve: Callable, schema: str) -> DataFrame:
    """Runs ``solve(keys, rows)`` on the rows of each task; many small tasks share a partition."""
    n_keys = len(keys)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "node")

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []
        last = None
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if row[:n_keys] != last:
                        if group:
                            out += solve(last, group)
                        group, last = [], row[:n_keys]
                        if len(out) > 10_000:
                            yield _batch(out, schema)
                            out = []
                    group.append(row[n_keys:])
        if group:
            out += solve(last, group)
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(per_partition, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _candidate_edges(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """u, v: spanning edges of the groups of pairs that pruning leaves."""
    limits = least_agreements(threshold, tolerance)

    def solve(task: tuple, rows: list[tuple]) -> list[tuple]:
        first = [r for r in rows if not r[1]]
        second = [r for r in rows if r[1]]
        within = task[1] == task[2]  # of one block; of two, one may have no members
        if not first or not (within or second):
            return []
        matrix = [np.frombuffer(b"".join(r[2] for r in part), KEPT).reshape(len(part), PERMUTATIONS) for part in (first, second)]
        return surviving(matrix[0], None if within else matrix[1], limits).edges([r[0] for r in first + second])

    tasks = _block_pairs(_buckets(nodes), "bucket", F.col("c") / F.lit(BLOCK))
    rows = tasks.join(nodes.select("node", "sig"), "node").select("bucket", "a", "b", "node", "second", "sig")
    return _by_task(rows, ["bucket", "a", "b"], solve, "u binary, v binary").distinct()


def _sets(source: DataFrame, texts: DataFrame) -> DataFrame:
    """node, shingles (bytes) of the texts (th) of candidate groups.

    A bit array of their names (of a size that has a bound) keeps most other texts unread.
    """

    def first_half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_heads(batch.column(0)).view(np.int64))], names=["h"])

    names = texts.select("th").mapInArrow(first_half, "h long").distinct().withColumn("n", F.lit(1).cast("long"))
    sent = source.sparkSession.sparkContext.broadcast(made(cut(names), arrays=("once",)))  # MOST_BITS at most

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                heads = _heads(batch.column(0))
                some = np.flatnonzero(known.has(heads, "once"))
                _, once = np.unique(heads[some], return_index=True)  # copies side by side are one
                yield batch.take(pa.array(some[np.sort(once)]))

        for texts in slices(chosen()):
            found = Shingles(texts)
            nodes, some = found.names(), found.full.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in some], pa.binary()), pa.array([found.set_of(i).tobytes() for i in some], pa.binary())], names=["node", "shingles"])

    return source.select("th", "text").mapInArrow(per_batch, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _heads(names: pa.Array) -> np.ndarray:
    """The first 64 bits of names of 128."""
    return np.frombuffer(b"".join(names.to_pylist()), np.uint64)[::2]


def _links(sets: DataFrame, threshold: float) -> DataFrame:
    """node, links (documents), other (a node of its class): exact links inside candidate groups."""

    def solve(task: tuple, rows: list[tuple]) -> list[tuple]:
        first = [r for r in rows if not r[1]]
        second = [r for r in rows if r[1]]
        within = task[1] == task[2]
        if not first or len(rows) < 2 or not (within or second):
            return []
        both = first + second
        sets = [np.frombuffer(r[3], np.uint64) for r in both]
        copies = np.array([r[2] for r in both])
        size = np.array([len(s) for s in sets])
        if not within:
            k = len(first)
            shared = intersections(sets, k)
            union = size[:k, None] + size[None, k:] - shared
        else:
            shared = intersections(sets)
            union = size[:, None] + size[None, :] - shared
        linked = shared >= threshold * union - 1e-9
        if not within:
            counts = np.concatenate([linked @ copies[k:], linked.T @ copies[:k]])
            i, j = np.nonzero(linked)
            j = j + k
        else:
            np.fill_diagonal(linked, False)
            counts = linked @ copies
            i, j = np.nonzero(np.triu(linked, 1))
        names = [r[0] for r in both]
        forest = Forest(len(names))
        forest.connect(i, j)
        root = dict(forest.edges(names))
        return [(names[x], int(counts[x]), root.get(names[x], names[x])) for x in np.flatnonzero(counts).tolist()]

    return _by_task(sets, ["root", "a", "b"], solve, "node binary, links long, other binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, th (hash of the text), class_node (null: no words), class_id and n_links of each row."""
    ship(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", text_name("text"))
    rows = store(_rows(source.select("doc_id", "th", "text")))
    nodes = store(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("size").alias("size"), F.min("th").alias("th")))
    n = nodes.count()
    groups = cut(components(_candidate_edges(nodes, threshold, tolerance), n), n)
    sized = cut(groups.join(nodes.select("node", "size", "th"), "node"), n)
    counts = cut(sized.groupBy("root").agg(F.greatest(F.count("*") / F.lit(SET_BLOCK), F.sum("size") * 8 / F.lit(SET_BYTES)).alias("blocks")), n)
    tasks = _block_pairs(groups.join(counts, "root"), "root", F.col("blocks")).join(nodes.select("node", "copies"), "node").join(_sets(source, sized), "node")
    links = cut(_links(tasks.select("root", "a", "b", "node", "second", "copies", "shingles"), threshold))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("u"), F.col("other").alias("v")), n)
    member = nodes.select("node", "copies", "least").join(linked, "node", "left").join(roots, "node", "left")
    member = cut(member.select("node", "least", F.coalesce("root", "node").alias("class_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), n)
    ids = cut(member.groupBy("class_node").agg(F.min("least").alias("class_id")), n)
    named = cut(member.join(ids, "class_node").select("node", "class_node", "class_id", "n_links"), n)
    out = rows.select("doc_id", "th", "node").join(named, "node", "left")
    return out.select("doc_id", "th", "class_node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id and n_links of each document."""
    return classes(docs, threshold, tolerance).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of each class, that of the least doc_id; rows without words all stay."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    key, text = plain[names.index("doc_id")], plain[names.index("text")]
    found = classes(docs.select("doc_id", "text"), threshold, tolerance).where("class_node IS NOT NULL")
    best = found.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("b"))
    chosen = best.select(_row_name(F.col("b.doc_id"), F.col("b.th")).alias("row"))
    rows = docs.toDF(*plain)
    worded = F.coalesce(F.col(text).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    # repeated rows become one before they are dealt, so none is hot, and the join needs no other deal
    once = rows.where(worded).withColumn("row", _row_name(F.col(key), text_name(text))).dropDuplicates(["row"])
    kept = once.join(chosen, "row", "left_semi").select(plain).unionByName(rows.where(~worded))
    return kept.select(*[F.col(p).alias(n) for p, n in zip(plain, names, strict=True)])


def _row_name(key: Column, th: Column) -> Column:
    """128 bits for a key, or none, with the name of a text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-")), F.lit("|"), F.hex(th)).cast("binary")))
