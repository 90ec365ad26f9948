import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tarnflow.llm import bitfilter, block_anchors, bwt_merge
from tarnflow.llm.common import text_name


def test_merge_finds_the_repeated_starts():
    rng = random.Random(3)
    for _ in range(200):
        letters = rng.choice([b"a", b"ab", b"abcd"])
        fragments = [bytes(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        length, rounds = rng.choice([(10, 5), (6, 3), (8, 4), (9, 3)])
        count = Counter(f[i : i + length] for f in fragments for i in range(len(f) - length + 1))
        got = bwt_merge.repeated_starts(fragments, length, rounds, rng.choice([10, 30, 1000]))
        for f, flags in zip(fragments, got, strict=True):
            assert flags.tolist() == [count[f[i : i + length]] > 1 for i in range(len(f) - length + 1)]


def test_fragments_that_occur_twice_repeat_through_the_merge():
    rng = random.Random(5)
    for _ in range(100):
        fragments = [bytes(rng.choices(b"ab", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        times = [rng.randint(1, 3) for _ in fragments]
        count = Counter()
        for f, n in zip(fragments, times, strict=True):
            for i in range(len(f) - 9):
                count[f[i : i + 10]] += n
        got = bwt_merge.repeated_starts(fragments, 10, 5, 30, times)
        for f, flags in zip(fragments, got, strict=True):
            assert flags.tolist() == [count[f[i : i + 10]] > 1 for i in range(len(f) - 9)]


def test_symbols_that_agree_by_one_hash_are_told_apart_by_the_other(monkeypatch):
    rng = random.Random(6)
    fragments = [bytes(rng.choices(b"abc", k=40)) for _ in range(10)]
    count = Counter(f[i : i + 10] for f in fragments for i in range(31))
    number, calls = bwt_merge._numbered, []

    def weak(h, other):
        calls.append(len(h))
        return number(h & np.uint64(7), other)

    monkeypatch.setattr(bwt_merge, "_numbered", weak)
    got = bwt_merge.repeated_starts(fragments, 10, 5)
    assert calls
    for f, flags in zip(fragments, got, strict=True):
        assert flags.tolist() == [count[f[i : i + 10]] > 1 for i in range(31)]


def test_a_filter_of_any_index_misses_nothing(spark):
    index = spark.range(20_000).selectExpr("xxhash64(id) AS h", "1 + id % 2 AS n")
    h = np.array([r.h for r in index.collect()]).view(np.uint64)
    twice = np.array([r.n for r in index.collect()]) > 1
    for bits in (1 << 31, 1 << 17, 1 << 16, 1 << 10):
        made = bitfilter.made(index, bits)
        assert made.has(h, "once").all() and made.has(h[twice], "twice").all()
        assert (made.log_bits == 0) == (bits < 40_000)
    made = bitfilter.made(index)
    assert made.has(np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), "once").mean() < 0.02 and made.has(h[~twice], "twice").mean() < 0.02
    parts = bitfilter.made(spark.range(400_000).selectExpr("xxhash64(id) AS h", "1L AS n"), arrays=("once",))
    assert parts.log_bits > 22 and parts.has(h, "once").all()
    assert not bitfilter.made(spark.range(0).selectExpr("id AS h", "id AS n")).has(h, "once").any()


def test_merged_order_is_sorted_and_blocks_are_common_prefixes():
    rng = random.Random(4)
    symbols = np.array([rng.randint(1, 3) for _ in range(60)])
    offsets = np.array([0, 13, 13, 30, 47, 60])
    rounds = 4
    bounds = ((0, 2), (2, 5))
    after = np.arange(1, 61)
    after[offsets[1:] - 1] = -1
    parts = []
    for a, b in bounds:
        low, high = offsets[a], offsets[b]
        parts.append(bwt_merge.ShardBwt(symbols[low:high], np.where(after[low:high] >= 0, after[low:high] - low, -1), rounds))
    source, within, block = bwt_merge.merge(parts, rounds)
    assert sorted(zip(source.tolist(), within.tolist(), strict=True)) == [(s, k) for s, p in enumerate(parts) for k in range(len(p.bwt))]
    seen = []
    for s, w, b in zip(source, within, block, strict=True):
        place = parts[s].place[w]
        if place >= 0:
            place += offsets[bounds[s][0]]
            stop = offsets[np.searchsorted(offsets, place, side="right")]
            seen.append((tuple(symbols[place : min(stop, place + rounds)].tolist()), b))
    assert [x for x, _ in seen] == sorted(x for x, _ in seen)
    for (x, a), (y, b) in zip(seen, seen[1:], strict=False):
        assert (a == b) == (x == y and len(x) == rounds)


def brute_bytes(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for key, d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [v for a, b in zip(*_runs(gone), strict=True) for v in (a, b)]
        out.append((key or -1, len(d), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return sorted(out)


def _runs(flags):
    edge = np.diff([0, *map(int, flags), 0])
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


@pytest.mark.parametrize(("length", "gram", "rounds", "hot"), [(200, 32, 5, 1024), (40, 8, 5, 1), (40, 8, 4, 3)])
def test_byte_repeats_equal_brute_force(awkward, length, gram, rounds, hot):
    got = bwt_merge.remove_repeats(awkward, length, gram, rounds, hot=hot).collect()
    want = brute_bytes([(r.doc_id, r.text) for r in awkward.collect()], length)
    assert sorted((r.doc_id or -1, r.n_bytes, list(r.spans), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("bits", [1 << 16, 1 << 3])
def test_byte_repeats_with_a_full_bit_array(awkward, bits):
    got = bwt_merge.remove_repeats(awkward, 40, 8, 5, most_bits=bits).collect()
    want = brute_bytes([(r.doc_id, r.text) for r in awkward.collect()], 40)
    assert sorted((r.doc_id or -1, r.n_bytes, list(r.spans), bytes(r.kept)) for r in got) == want


def brute_words(rows, window):
    data = [(r[0], (r[1] or "").encode().split()) for r in rows]
    count = Counter(tuple(w[i : i + window]) for _, w in data for i in range(len(w) - window + 1))
    out = []
    for key, w in data:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((key or -1, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize(("window", "bits"), [(35, 1 << 31), (7, 1 << 31), (7, 1 << 16), (7, 1 << 3)])
def test_word_repeats_equal_brute_force(awkward, window, bits):
    got = block_anchors.remove_repeats(awkward, window, bits).collect()
    want = brute_words([(r.doc_id, r.text) for r in awkward.collect()], window)
    assert sorted((r.doc_id or -1, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r.kept) for r in got) == want


def test_copies_of_a_row_without_a_key_are_collected_once(spark):
    text = "some words that go on and on " * 20
    docs = spark.createDataFrame([(None, text)] * 300, "doc_id long, text string").repartition(4)
    rows = docs.withColumn("th", text_name("text"))
    assert [len(r.found) for r in bwt_merge.repeated_spans(rows).collect()] == [len({(x.first, tuple(x.starts)) for r in bwt_merge.repeated_spans(rows).collect() for x in r.found})]
    assert {len(r.kept) for r in bwt_merge.remove_repeats(docs).collect()} == {0}
    [found] = block_anchors.repeated_windows(rows).collect()
    assert len(found.starts) == len({(x.first, x.bits) for x in found.starts})


def test_empty_tables(no_docs):
    assert bwt_merge.remove_repeats(no_docs).count() == 0
    assert block_anchors.remove_repeats(no_docs).count() == 0


def test_bwt_query_on_the_smallest_tables(spark, sf):
    from tarnflow.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (n, sum(s[1::2]) - sum(s[::2]), len(s) // 2, hashlib.sha256(kept).hexdigest()) for k, n, s, kept in brute_bytes([(i + 1, t) for i, t in rows], 200)}
    got = {r.doc_id + 1: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op2_bwt_repeats"](spark, sf).collect()}
    assert got == want
