import random

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import chat_format, packing

TURNS = "conv_id long, turn long, role string, text string"


def brute_maximal(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    lists = {c: [v[2:] for v in sorted(turns)] for c, turns in convs.items()}
    out = []
    for c, a in lists.items():
        same = [d for d, b in lists.items() if b == a]
        if c == min(same) and not any(len(b) > len(a) and b[: len(a)] == a for b in lists.values()):
            out.append((c, len(a), len(same)))
    return sorted(out)


def test_maximal_conversations(spark):
    rng = random.Random(3)
    rows = []
    stories = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "no", "", None, "<|user|>"])) for _ in range(8)] for _ in range(6)]
    for c in range(60):
        story = rng.choice(stories)[: rng.randint(1, 8)]
        rows += [(c, t * 2, r, x) for t, (r, x) in enumerate(story)]
    rows += [(None, 0, "user", "lost"), (70, None, "user", "a"), (70, None, "user", "a"), (70, 1, None, None), (71, 0, "user", "a"), (72, 0, "user", "1:a"), (72, 1, "x", "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], TURNS + ", hash string").repartition(4)
    got = chat_format.format_chats(df)
    assert sorted((r.conv_id, r.n_turns, r.n_same) for r in got.collect()) == brute_maximal(rows)
    assert all(r.rendered.count("<|end|>") == r.n_turns for r in got.collect())
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_rendering_keeps_marks_apart(spark):
    df = spark.createDataFrame([(1, 0, "user", "say <|end|> now"), (1, 1, "assistant", "no")], TURNS)
    assert chat_format.format_chats(df).first().rendered == "<|user|>\nsay < |end|> now\n<|end|>\n<|assistant|>\nno\n<|end|>\n"


def brute_fit(items, capacity, per_source):
    """Best fit by looking at all bins."""
    bins, placed = [], []
    for length, source, cluster in items:
        best = None
        for b, (used, sources, clusters) in enumerate(bins):
            fits = capacity - used >= length and sources.count(source) < per_source and (cluster is None or cluster not in clusters)
            if fits and (best is None or (capacity - used, b) < best):
                best = (capacity - used, b)
        if best is None:
            bins.append([0, [], []])
            best = (capacity, len(bins) - 1)
        b = best[1]
        placed.append((b, bins[b][0]))
        bins[b][0] += length
        bins[b][1].append(source)
        bins[b][2].append(cluster)
    return placed


@pytest.mark.parametrize("per_source", [1, 2, 3])
def test_best_fit_equals_brute_force(per_source):
    rng = random.Random(per_source)
    for _ in range(100):
        items = [(rng.randint(0, 30), rng.randint(0, 3), rng.choice([None, 0, 1, 2, 3, 4, 5])) for _ in range(40)]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(items, 32, per_source) == brute_fit(items, 32, per_source)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    from tarnflow.llm.queries import tokenizer_path

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def brute_pieces(text, library, capacity):
    """(first, last, tokens): words of a text of single spaces, as many as fit."""
    if len(library.encode(text)) <= capacity:
        return [(0, len(text), len(library.encode(text)))]
    out, at = [], 0
    words = text.split(" ")
    while words:
        k = max(k for k in range(1, len(words) + 1) if len(library.encode(" ".join(words[:k]))) <= capacity)
        part = " ".join(words[:k])
        out.append((at, at + len(part), len(library.encode(part))))
        at += len(part) + 1
        words = words[k:]
    return out


def brute_packing(docs, library, capacity, per_source, clusters):
    """(key, piece, first, last, n, bin, start) of docs (key, text, source), in one shard."""
    items = []
    for key, text, source in docs:
        for k, (a, b, n) in enumerate(brute_pieces(text or "", library, capacity)):
            items.append((-n, key, k, source, clusters[text or ""], a, b))
    items.sort(key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2], x[3] is None, x[3] or "", x[4]))
    placed = brute_fit([(-n, source, cluster) for n, _, _, source, cluster, _, _ in items], capacity, per_source)
    return sorted(((key is None, key or 0), k, a, b, -n, f"0-{bin_}", start) for (n, key, k, _, _, a, b), (bin_, start) in zip(items, placed, strict=True))


def test_the_whole_query_equals_brute_force(spark, library):
    from tarnflow.llm.queries import tokenizer_path

    from .conftest import prose

    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randint(1, 30)), rng.choice(["a", "b", "c", None])) for k in range(60)]
    rows += [(70, prose(rng, 300), "a"), (71, prose(rng, 90), "b"), (72, "", "a"), (73, None, None), (74, "?!", "c"), (75, "?!", "b"), (None, "no key here", "a"), (None, "no key either", "b"), (76, rows[5][1], "b"), (76, rows[5][1], "b")]
    clusters = {t or "": t or "" for _, t, _ in rows}
    docs = spark.createDataFrame([(k, t, s, 1, "x") for k, t, s in rows], "doc_id long, text string, source string, bin int, th string").repartition(3)
    found = packing.pieces(docs, tokenizer_path(), capacity=48)
    names = {r.cluster.hex(): r for r in found.select("cluster").distinct().collect()}
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.piece, r.first, r.last, r.n_tokens, r.bin, r.start) for r in packing.pack(found, 48, 2).collect())
    ordered = {}  # the brute force needs the operator's names of clusters only to break ties
    for r in found.collect():
        for k, t, s in rows:
            if (k, s) == (r.key, r.source) and (k is not None or len(t) == r.last):
                ordered[t or ""] = r.cluster.hex()
    assert len(names) == len(set(clusters.values())) == len(set(ordered.values()))
    assert got == brute_packing(rows, library, 48, 2, ordered)


def test_hot_and_missing_keys_are_spread_over_shards(spark):
    items = spark.range(4000).selectExpr("id AS row", "CAST(NULL AS BIGINT) AS key", "'s' AS source", "0L AS piece", "0L AS first", "1L AS last", "1L AS n_tokens", "CAST('same' AS BINARY) AS cluster")
    shards = {}
    for r in packing.pack(items, shard_rows=100).collect():
        shards[r.bin.split("-")[0]] = shards.get(r.bin.split("-")[0], 0) + 1
    assert len(shards) == 40 and max(shards.values()) < 200


def test_bins_hold_the_texts(spark, library, awkward):
    from tarnflow.llm.queries import tokenizer_path

    bins = packing.pack(packing.pieces(awkward.withColumn("row", F.lit(1)), tokenizer_path(), capacity=64, with_text=True), 64, as_bins=True).collect()
    by_text = {}
    for b in bins:
        at = 0
        for p in b.pieces:
            assert p.start == at and p.n_tokens == len(library.encode(p.text)) and len(p.text) == p.last - p.first
            at += p.n_tokens
        assert b.used == at <= 64 and b.fill == at / 64 and b.n_pieces == len(b.pieces)
        for p in b.pieces:
            by_text.setdefault(p.key, []).append((p.piece, p.first, p.last, p.text))
    want = {}
    for r in awkward.collect():
        want.setdefault(r.doc_id, []).append(r.text or "")
    for key, found in by_text.items():
        if len(want[key]) > 1:  # rows of one key can't be told apart by it: here equal ones, or short ones
            assert len([x for x in found if x[0] == 0]) == len(want[key])
            continue
        at, rebuilt = 0, ""
        for _, first, last, text in sorted(found):
            rebuilt += " " * (first - at) + text
            at = last
        assert rebuilt == want[key][0]
    assert set(by_text) == set(want)


def test_packing_nothing(no_docs):
    from tarnflow.llm.queries import tokenizer_path

    for with_text in (False, True):
        found = packing.pieces(no_docs, tokenizer_path(), with_text=with_text)
        assert packing.pack(found).count() == 0 and packing.pack(found, as_bins=True).count() == 0


def test_packing_queries_count_real_tokens(spark, tmp_path, awkward, library):
    import corpus_pipeline as cp
    from tarnflow.llm import queries

    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    got = {}
    for r in queries.op4(spark, str(tmp_path)).collect():
        assert r.start + r.n_tokens <= packing.CAPACITY
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(texts) and any(r.piece for rows in got.values() for r in rows)
    for key, rows in got.items():
        for r in rows:
            assert r.n_tokens in {len(library.encode(t[r.first : r.last])) for t in texts[key]}
    total = sum(r.n_tokens for rows in got.values() for r in rows)
    bins = cp.pack_sequences(spark, awkward, str(tmp_path)).collect()
    assert sum(b.used for b in bins) == total and all(b.used <= packing.CAPACITY for b in bins)


def test_near_copies_share_no_bin(spark, tmp_path):
    import corpus_pipeline as cp
    from tarnflow.llm import queries

    rng = random.Random(8)
    rows, family = [], {}
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for copy in range(4):
            rows.append((4 * k + copy, " ".join([*words, f"end{copy}"]), f"s{4 * k + copy}"))
            family[4 * k + copy] = k
    rows += [(100, "?!", "a"), (101, "?!", "b"), (102, None, "c"), (103, "", "d"), (104, "!!", "e")]
    family |= {100: "mark", 101: "mark", 102: "none", 103: "none", 104: "other"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    of_bin = {}
    for r in queries.op4(spark, str(tmp_path)).collect():
        of_bin.setdefault(r.bin, []).append(family[r.doc_id])
    of_pipeline = {b.bin: [family[p.key] for p in b.pieces] for b in cp.pack_sequences(spark, docs, str(tmp_path)).collect()}
    for bins in (of_bin, of_pipeline):
        assert sum(map(len, bins.values())) == len(rows)
        assert all(len(set(x)) == len(x) for x in bins.values())
