"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and texts are normalised the same way: A to Z lowered, words of digits, letters and characters
above ASCII. One automaton over the words of all items is built on the driver and sent to the
workers; a test set above ``block_words`` words becomes several automata, and an item above that is
divided into parts that share ``window`` - 1 words, so what is built and sent has a bound that no test
set passes. The driver reads the items a partition at a time. Each automaton is used by a pass of its
own over the same rows; passes are jobs with a written table between them, so a worker holds one
automaton. A text streams through the automaton, which keeps the longest match that ends at each word.
A match of ``window`` words or more (or of a whole shorter item) is a hit: its words count as copied,
and the items whose window ends there are known from the state. A state names the shorter items that
end there itself and links to the next state that does, so items are listed once however many states
end with them.

Words are looked up by hash first, so only runs of words that some item has are streamed; the
automaton itself compares the words, not hashes.

Nulls and texts without words: no words, no hits. Items without words are never hit. Repeated rows
are judged each; repeated items are all reported. An item with a null id is hit as any other: its words
count in n_hit and spans, it isn't named in item_ids, and n_items counts all such items as one more.
Items of one word or window are all hit by it, none before another; item_ids are sorted. Texts of any
length are read whole, by one task each. An empty table of texts gives no rows, an empty test set no
hits. Columns named as the results are replaced by ``scan``; ``clean`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import Texts, Words, ship, slices, store

WINDOW = 10
#: Words of test items in one automaton; the bound on what is sent to a worker at once.
BLOCK_WORDS = 200_000
#: Stands for a null id in an automaton; no string of Spark's holds a lone surrogate.
NO_ID = "\ud800"


class SuffixAutomaton:
    """All runs of words of some items. State 0 is the empty run."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[tuple[str, list[bytes]]] = []

    def add(self, item: str, words: list[bytes]) -> None:
        self.items.append((item, words))
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return cur

    def _state(self, length: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def finish(self) -> SuffixAutomaton:
        """Marks the states whose window of words, or whole short item, belongs to some item."""
        n = len(self.length)
        #: items by the mark of a hit: (state, 0) for windows, (state, words) for whole shorter items
        self.named: dict[tuple[int, int], list[str]] = {}
        order = sorted(range(n), key=self.length.__getitem__)
        #: the state of the suffix of `window` words, for longer states
        self.cut = list(range(n))
        for s in order:
            if self.link[s] >= 0 and self.length[self.link[s]] >= self.window:
                self.cut[s] = self.cut[self.link[s]]
        owned: dict[int, set[str]] = {}
        for item, words in self.items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    owned.setdefault(self.cut[state], set()).add(item)
            if 0 < len(words) < self.window:
                self.named.setdefault((state, len(words)), []).append(item)
        #: the words of the shorter items that end a state's runs, longest first, and where to look on
        self.short: dict[int, list[int]] = {}
        for s, size in sorted(self.named, key=lambda x: -x[1]):
            self.short.setdefault(s, []).append(size)
        self.named |= {(s, 0): sorted(x) for s, x in owned.items()}
        self.below = [0] * n
        for s in order:
            if s:
                self.below[s] = s if s in self.short else self.below[self.link[s]]
        self.least = min([self.window, *(len(w) for _, w in self.items if w)])
        self.items = []
        return self

    def vocabulary(self) -> list[bytes]:
        return list(self.next[0])

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, int]]]:
        """(first word, end, mark) of each window, or shorter item, that ends at some word."""
        state = size = 0
        below, short = self.below, self.short
        moves, link, length, window = self.next, self.link, self.length, self.window
        for i, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                size = length[state]
            if word in moves[state]:
                state = moves[state][word]
                size += 1
            if size >= window:
                yield i + 1 - window, i + 1, (self.cut[state], 0)
            s = below[state]
            while s:
                for k in short[s]:
                    if k <= size:
                        yield i + 1 - k, i + 1, (s, k)
                s = below[link[s]]


def words_of(texts: Texts) -> list[list[bytes]]:
    words = Words(texts)
    data = words.data.tobytes()
    flat = [data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    return [flat[a:b] for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]


def automata(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over the items, each of ``block_words`` words, or ``window`` if that is more, at most."""
    block, size = SuffixAutomaton(window), 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        [words] = words_of(Texts(pa.RecordBatch.from_arrays([pa.array([row.t], pa.string())], names=["t"]), "t"))
        most = max(block_words, window)
        for k in range(0, max(1, len(words) - window + 1), most - window + 1):
            part = words[k : k + most]
            if size and size + len(part) > block_words:
                yield block.finish()
                block, size = SuffixAutomaton(window), 0
            block.add(NO_ID if row.i is None else row.i, part)
            size += len(part)
    yield block.finish()


def scan(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted array of strings), n_items and spans.

    ``spans`` holds start, end, start, end ... in words: the maximal runs of hit words.
    """
    df, schema, last = _but_last(docs, items, text, window, block_words)
    return df.mapInArrow(last, schema)


def _but_last(docs: DataFrame, items: DataFrame, text: str, window: int, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, T.StructType, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """``docs`` after all passes but one, the schema that every pass gives, and the pass that is left."""
    ship(docs.sparkSession)
    added = ["n_words", "n_hit", "item_ids", "n_items", "spans"]
    rest = [c for c in docs.columns if c not in added]
    df = docs.select([F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("n_items", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType()))])
    sent = None
    for automaton in automata(items, window=window, block_words=block_words):
        if sent is not None:
            df = store(df.mapInArrow(last, schema))
            sent.destroy()
        again, sent = sent is not None, df.sparkSession.sparkContext.broadcast(automaton)
        last = _pass(sent, text, rest, again)
    return df, schema, last


def _pass(sent, text: str, rest: list[str], again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        probe = [b" ".join(automaton.vocabulary())]
        known = np.unique(Words(Texts(pa.RecordBatch.from_arrays([pa.array(probe, pa.binary())], names=["t"]), "t")).hash)
        for texts in slices(batches, text):
            n_hit, items, n_items, spans = [], [], [], []
            words = Words(texts)
            if len(known):
                at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
                seen = known[at] == words.hash
            else:
                seen = np.zeros(len(words.hash), bool)
            hits: dict[int, list[tuple[int, int]]] = {}
            marks: dict[int, set[tuple[int, int]]] = {}
            data = None
            lo, hi = _long_runs(seen, words.offsets, automaton.least)
            rows = np.searchsorted(words.offsets, lo, side="right") - 1
            for a, b, row in zip(lo.tolist(), hi.tolist(), rows.tolist(), strict=True):
                if data is None:
                    data = words.data.tobytes()
                run_words = [data[x:y] for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
                base = a - int(words.offsets[row])
                for x, y, mark in automaton.stream(run_words):
                    hits.setdefault(row, []).append((base + x, base + y))
                    marks.setdefault(row, set()).add(mark)
            if again:
                old_items, old_n, old_spans = texts.column("item_ids"), texts.column("n_items"), texts.column("spans")
            for row in range(texts.n):
                pairs, found = hits.get(row, []), set().union(*(automaton.named[m] for m in marks.get(row, ())))
                if again:
                    flat = old_spans[row].as_py()
                    pairs = pairs + list(zip(flat[::2], flat[1::2], strict=True))
                    old = old_items[row].as_py()
                    found = found | set(old) | ({NO_ID} if old_n[row].as_py() > len(old) else set())
                union = merged(pairs)
                n_hit.append(sum(y - x for x, y in union))
                n_items.append(len(found))
                items.append(sorted(found - {NO_ID}))
                spans.append([v for pair in union for v in pair])
            arrays = [texts.column(c) for c in rest]
            arrays += [pa.array(np.diff(words.offsets), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(n_items, pa.int64()), pa.array(spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n_words", "n_hit", "item_ids", "n_items", "spans"])

    return run


def _long_runs(seen: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words of one row, ``least`` words or more."""
    n = len(seen)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], seen[:-1]])
    after = np.concatenate([seen[1:], [False]])
    lo = np.flatnonzero(seen & (~before | cut[:-1]))
    hi = np.flatnonzero(seen & (~after | cut[1:])) + 1
    keep = hi - lo >= least
    return lo[keep], hi[keep]


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, as maximal ranges."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(pairs):
        if out and x <= out[-1][1]:
            if y > out[-1][1]:
                out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def clean(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without copied passages.

    A text of whose words more than ``max_coverage`` are hit goes; from another, the stretch from
    the first to the last character of each hit run is cut. Texts without hits stay as they are.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    place = plain[names.index(text)]
    df, _, last = _but_last(docs.toDF(*plain), items, place, window)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in last(batches):  # in one worker: a second Python step would take another, which stays
            n_words, n_hit = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_words", "n_hit"))
            texts = Texts(batch.filter(pa.array((n_hit == 0) | (n_hit <= n_words * max_coverage))), place)
            words = Words(texts) if n_hit.any() else None
            raw, spans = texts.column(place), texts.column("spans")
            out = []
            for row in range(texts.n):
                flat = spans[row].as_py()
                if not flat:
                    out.append(raw[row].as_py())
                    continue
                begin, stop, first = int(texts.offsets[row]), int(texts.offsets[row + 1]), int(words.offsets[row])
                parts, at = [], begin
                for x, y in zip(flat[::2], flat[1::2], strict=True):
                    parts.append(texts.bytes[at : words.start[first + x]].tobytes())
                    at = int(words.end[first + y - 1])
                parts.append(texts.bytes[at:stop].tobytes())
                out.append(b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == place else texts.column(c) for c in plain], names=names)

    return df.mapInArrow(cut_out, docs.schema)
