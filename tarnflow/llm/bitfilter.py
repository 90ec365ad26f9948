"""A bit array over hashes, made by tasks part by part, of a size that has a bound.

A build takes an index of any size: there is a task for each part of the array, or a few parts, which
reads its rows as a stream and holds a part as flags (4 MB). Above ``most_bits / LEAST_EACH`` hashes an array would let
nearly all through, so none is made and every hash passes; what is exact comes after the filter
either way, and no result changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import mix, together

#: Bits for each hash, the fewest that are of use, and the most bits an array may have (256 MB).
BITS_EACH, LEAST_EACH, MOST_BITS = 16, 2, 1 << 31
_SLAB = 22  # log2 of the bits in one part
#: Bytes of rows that a task looks at together.
STEP_BYTES = 1 << 20


class BitFilter:
    """Bit arrays over 64-bit hashes: ``once`` for those that occur, ``twice`` for those that do so again.

    Without arrays (``log_bits`` 0) every hash passes.
    """

    def __init__(self, log_bits: int, **arrays: np.ndarray):
        self.log_bits, self.arrays = log_bits, arrays

    @staticmethod
    def places(h: np.ndarray, log_bits: int) -> Iterator[np.ndarray]:
        """Four bit numbers for each hash, all in the part that its leading bits choose."""
        low = min(16, log_bits)
        base = (h >> np.uint64(64 - (log_bits - low)) << np.uint64(low)) if log_bits > low else np.zeros(len(h), np.uint64)
        mask = np.uint64((1 << low) - 1)
        more = mix(h)
        for part in (h, h >> np.uint64(16), more, more >> np.uint64(20)):
            yield (base | (part & mask)).astype(np.int64)

    def has(self, h: np.ndarray, name: str) -> np.ndarray:
        """Flags of the hashes that may be in the array ``name``; no hash of it is missed."""
        if not self.log_bits:
            return np.ones(len(h), bool)
        array = self.arrays[name]
        found = np.arange(len(h))
        for k in range(4):
            places = next(p for i, p in enumerate(self.places(h[found], self.log_bits)) if i == k)
            found = found[(array[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[found] = True
        return out


def made(index: DataFrame, most_bits: int = MOST_BITS, arrays: tuple[str, ...] = ("once", "twice")) -> BitFilter:
    """The filter of an index of distinct hashes (h) with counts (n), which should be checkpointed."""
    n = index.count()
    if n > most_bits // LEAST_EACH:
        return BitFilter(0)
    log_bits = min(max(16, math.ceil(math.log2(max(1, n) * BITS_EACH))), int(math.log2(most_bits)))
    slab = min(_SLAB, log_bits)
    width = (1 << slab) // 8

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[str, int], np.ndarray] = {}
        for batch in together(batches, STEP_BYTES):
            h = batch.column(0).to_numpy().view(np.uint64)
            for name in arrays:
                some = h if name == "once" else h[batch.column(1).to_numpy() > 1]
                number = some >> np.uint64(64 - (log_bits - slab)) if log_bits > slab else np.zeros(len(some), np.uint64)
                for part in np.unique(number).tolist():
                    if (name, part) not in parts:
                        parts[name, part] = np.zeros(1 << slab, bool)
                    for places in BitFilter.places(some[number == part], log_bits):
                        parts[name, part][places & ((1 << slab) - 1)] = True
        for (name, part), flags in parts.items():
            yield pa.RecordBatch.from_pydict({"name": [name], "slab": [part], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    tasks = 1 << log_bits - slab
    number = F.shiftrightunsigned("h", 64 - (log_bits - slab)) if log_bits > slab else F.lit(0)
    dealt = index.select("h", "n").repartition(tasks, number) if tasks > 1 else index.select("h", "n")
    found = {name: np.zeros((1 << log_bits) // 8, np.uint8) for name in arrays}
    for row in dealt.mapInArrow(make, "name string, slab long, bits binary").toLocalIterator():
        found[row.name][row.slab * width : (row.slab + 1) * width] |= np.frombuffer(row.bits, np.uint8)
    return BitFilter(log_bits, **found)
