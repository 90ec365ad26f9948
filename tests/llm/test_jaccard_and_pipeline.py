import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import jaccard_join as jj
from tarnflow.llm.components import components

from .conftest import DOCS, awkward_rows, prose
from .test_decontaminate import LOWER, WORD, words
from .test_secret_scan import KINDS


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(class id, links) of each row, in order."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [k for j, (k, _) in enumerate(rows) if find(j) == find(i) and k is not None]
        out.append((key if key is not None else -1, min(ids) if ids and sets[i] else (key if key is not None else -1), links[i]))
    return sorted(out)


def near_rows(seed):
    rng = random.Random(seed)
    rows = awkward_rows(seed)
    base = prose(rng, 150).split()
    for k in range(100, 160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randint(0, len(w) - 1)] = rng.choice(["changed", "other", "words"])
        rows.append((k, " ".join(w), "en", "hot", 1))
    return rows


@pytest.mark.parametrize(("block", "set_block", "set_bytes"), [(1024, 512, 1 << 25), (7, 5, 1 << 25), (8192, 512, 3000)])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, block, set_block, set_bytes):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "SET_BLOCK", set_block)
    monkeypatch.setattr(jj, "SET_BYTES", set_bytes)
    rows = near_rows(block)
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1)).repartition(3)
    got = jj.near_duplicates(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == brute([r[:2] for r in rows])


def test_one_of_each_class_stays(spark):
    rows = near_rows(4)
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    want = brute([r[:2] for r in rows])
    bare = [r[0] for r in rows if not words(r[1])]
    alone = [r[0] for r in rows if r[0] is None and words(r[1])]  # the one text without a key has no double
    classes = {c for k, c, _ in want if k == c and k != -1} - set(bare)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(k or -1 for k in [*classes, *bare, *alone])


def test_no_documents(spark, no_docs):
    assert jj.near_duplicates(no_docs).count() == 0 and jj.keep_one(no_docs).count() == 0


def test_limits_keep_pairs_at_the_threshold():
    limits = jj.least_agreements(0.8, 1e-6)
    assert limits[-1][0] == jj.PERMUTATIONS and all(m < 0.8 * n for n, m in limits)
    rng = np.random.default_rng(1)
    n = 4000
    left = rng.integers(0, 2**32, (1, jj.PERMUTATIONS), dtype=np.uint32)
    right = np.where(rng.random((n, jj.PERMUTATIONS)) < 0.8, left, left + 1)
    assert (jj.surviving(left, right.astype(np.uint32), limits).label == 0).all()
    far = np.where(rng.random((n, jj.PERMUTATIONS)) < 0.3, left, left + 1)
    assert (jj.surviving(left, far.astype(np.uint32), limits).label == np.arange(n + 1)).all()


@pytest.mark.parametrize("split", [None, 90])
def test_pruning_connects_as_all_pairs_do(split):
    rng = np.random.default_rng(3)
    limits = jj.least_agreements(0.8, 1e-6)
    base = rng.integers(0, 2**16, (12, jj.PERMUTATIONS), dtype=np.uint16)
    rows = np.where(rng.random((200, jj.PERMUTATIONS)) < rng.choice([0.5, 0.8, 0.95], (200, 1)), base[rng.integers(0, 12, 200)], 0)
    want = jj.Forest(200)
    for i in range(200):
        for j in range(i):
            if split is None or (j < split <= i):
                if all((rows[i, :n] == rows[j, :n]).sum() >= least for n, least in limits):
                    want.connect(np.array([j]), np.array([i]))
    got = jj.surviving(rows if split is None else rows[:split], None if split is None else rows[split:], limits)
    assert (got.label == want.label).all() and len(set(want.label.tolist())) < 200


def test_intersections():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), np.uint64) for _ in range(20)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    got = jj.intersections(sets)
    off = ~np.eye(20, dtype=bool)
    assert (got[off] == want[off]).all()
    assert (jj.intersections(sets, 7) == want[:7, 7:]).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)] + [(600, 600)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), 1000).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


# ---------------------------------------------------------------- the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(77)
    rows = near_rows(12)
    for k in range(200, 260):
        text = prose(rng, 40) + (" you idiot scumbag" if k % 3 == 0 else "")
        rows.append((k, text, "en", "s", len(text)))
    passage = prose(rng, 30)
    rows.append((300, prose(rng, 50) + " " + passage + " " + prose(rng, 50), "en", "s", 1))
    rows.append((301, passage, "en", "s", 1))
    rows.append((302, prose(rng, 30) + " password=hunter22hunter " + prose(rng, 10), "en", "s", None))
    base = str(tmp_path_factory.mktemp("tables"))
    extra = [(*r, "clash", None, 1.5) for r in rows]
    spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, spans string, th string, score double").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(200, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, {r[0]: r for r in rows}, passage


def test_stages(spark, folder):
    import corpus_pipeline as cp

    base, rows, passage = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    n0 = docs.count()

    clean = cp.drop_toxic(spark, docs, base).cache()
    assert clean.columns == columns
    ids = {r.doc_id for r in clean.collect()}
    assert all((k in ids) == (k % 3 != 0) for k in range(200, 260))
    assert clean.count() == n0 - 20

    single = cp.drop_near_duplicates(spark, clean, base).cache()
    assert single.columns == columns
    left = brute([(r.doc_id, r.text) for r in clean.collect()])
    got = {r.doc_id for r in single.collect()}
    assert {c for k, c, _ in left if k == c and k != -1} <= got and not any(k in got for k, c, _ in left if k != c and k != -1)

    bare = cp.drop_benchmark_passages(spark, single, base).cache()
    assert bare.columns == columns
    texts = {r.doc_id: r for r in bare.collect()}
    assert 301 not in texts and passage not in texts[300].text and len(texts[300].text) == texts[300].n_chars
    before = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == before[k] for k, r in texts.items() if k not in (300, None)) and bare.count() == single.count() - 1

    safe = cp.redact_secrets(spark, bare, base).cache()
    assert safe.columns == columns and safe.count() == bare.count()
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert "hunter22" not in texts[302] and "[SECRET]" in texts[302]

    bins = cp.pack_sequences(spark, safe, base).collect()
    packed = sorted((-1 if p.key is None else p.key) for b in bins for p in b.pieces if p.piece == 0)
    assert packed == sorted(-1 if r.doc_id is None else r.doc_id for r in safe.collect())
    parts = {}
    for b in bins:
        for p in b.pieces:
            parts.setdefault((p.key, p.last if p.key is None else 0), []).append(p)
    rebuilt = []
    for (key, _), own in parts.items():
        at, text = 0, ""
        for p in sorted(own, key=lambda p: p.piece):
            text += " " * (p.first - at) + p.text
            at = p.last
        rebuilt.append((-1 if key is None else key, text))
    assert sorted(rebuilt) == sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in safe.collect())


def test_run_equals_the_stages(spark, folder):
    import corpus_pipeline as cp

    out = cp.run(spark, folder[0])
    assert out.columns == ["bin", "n_pieces", "used", "fill", "pieces"] and out.count() > 0
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def plain_duplicates(docs):
    """Of each class of texts with words the one of the least key; every text without words."""
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for (key, text), words_, g in zip(docs, sets, group, strict=True):
        if words_ and (g not in best or (key is None, key or 0) < (best[g][0] is None, best[g][0] or 0)):
            best[g] = (key, text)
    return [*best.values(), *(d for d, words_ in zip(docs, sets, strict=True) if not words_)]


def plain_decontamination(docs, items):
    out = []
    for key, text in docs:
        places = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
        w, hit = words(text), set()
        for item in items:
            v = words(item)
            k = min(10, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
        if len(hit) > 0.5 * len(w):
            continue
        for i in sorted(hit, reverse=True):  # from a hit word to the next, if that is hit as well
            text = text[: places[i][0]] + text[rest if i + 1 in hit else places[i][1] :]
            rest = places[i][0]
        out.append((key, text))
    return out


def plain_redaction(docs):
    out = []
    for key, text in docs:
        spans = [m.span() for _, pattern, group, least in KINDS for m in pattern.finditer(text or "") if len(m[group]) >= least]
        joined = []
        for a, b in sorted(spans):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        for a, b in reversed(joined):
            text = text[:a] + "[SECRET]" + text[b:]
        out.append((key, text or ""))
    return out


def test_the_whole_pipeline_equals_a_plain_one(spark, folder):
    import corpus_pipeline as cp

    base, _, passage = folder
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    docs = [d for d in docs if not (d[0] is not None and 200 <= d[0] < 260 and d[0] % 3 == 0)]  # the toxic ones
    want = plain_redaction(plain_decontamination(plain_duplicates(docs), [passage]))
    parts = {}
    for b in cp.run(spark, base).collect():
        assert sum(p.n_tokens for p in b.pieces) == b.used <= 4096
        for p in b.pieces:
            parts.setdefault((p.key, p.last if p.key is None else 0), []).append(p)
    got = []
    for (key, _), own in parts.items():
        at, text = 0, ""
        for p in sorted(own, key=lambda p: p.piece):
            text += " " * (p.first - at) + p.text
            at = p.last
        got.append((key, text))
    order = lambda d: (d[0] is None, d[0] or 0, d[1])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_pipeline_of_empty_tables(spark, tmp_path, no_docs):
    import corpus_pipeline as cp

    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
