import random
import re

import pyarrow as pa
import pytest

from tarnflow.llm import decontaminate as dc
from tarnflow.llm.common import Texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            if not k:
                continue
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add(item)
        out.append((key or -1, len(w), len(hit), sorted(str(i) for i in found if i is not None), len(found)))
    return sorted(out)


def items_of(rows):
    rng = random.Random(2)
    long = [w for _, t, *_ in rows if t for w in [t.split()] if len(w) > 60]
    out = [(1, None), (2, ""), (3, "?!"), (4, "One"), (5, "alphas betas gammas"), (6, "not in any text at all"), (None, "one")]
    for k in range(7, 14):
        w = rng.choice(long)
        i = rng.randint(0, len(w) - 25)
        out.append((k, "Before. " + " ".join(w[i : i + rng.randint(8, 25)]).upper()))
    return [*out, (7, out[-1][1])]


@pytest.mark.parametrize(("window", "block"), [(10, 200_000), (3, 200_000), (10, 20), (4, 7)])
def test_hits_equal_brute_force(spark, awkward, window, block):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.scan(awkward.select("doc_id", "text"), bench, window=window, block_words=block).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r.item_ids), r.n_items) for r in got) == brute(rows, items, window)
    for r in got:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit


def test_automaton_on_random_words():
    rng = random.Random(8)
    for _ in range(150):
        items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]) for k in range(rng.randint(1, 5))]
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(30)]
        window = rng.randint(1, 5)
        automaton = dc.SuffixAutomaton(window)
        for item, w in items:
            automaton.add(item, w)
        automaton.finish()
        got = {(x, y, i) for x, y, mark in automaton.stream(text) for i in automaton.named[mark]}
        want = set()
        for item, w in items:
            k = min(window, len(w))
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
            want |= {(i, i + k, item) for i in range(len(text) - k + 1) if k and tuple(text[i : i + k]) in grams}
        assert got == want


def test_items_that_end_many_states_are_listed_once():
    automaton = dc.SuffixAutomaton(10)
    for k in range(3000):
        automaton.add(f"y{k}", [b"yes"])
        automaton.add(f"n{k}", [b"no", b"x%d" % k, b"yes"])
    automaton.finish()
    assert sum(map(len, automaton.named.values())) == 6000
    marks = {m for _, _, m in automaton.stream([b"no", b"x7", b"yes"])}
    assert sorted(i for m in marks for i in automaton.named[m]) == sorted(["n7", *(f"y{k}" for k in range(3000))])


def test_a_long_item_is_divided(spark):
    words = [f"w{k}" for k in range(100)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "w5 w6")], "item_id long, text string")
    blocks = list(dc.automata(bench, window=4, block_words=9))
    assert len(blocks) > 10 and all(len(b.next[0]) <= 9 for b in blocks)
    docs = spark.createDataFrame([(1, "x " + " ".join(words[20:60]) + " y"), (2, " ".join(words)), (3, "w98 w99 w0 w1")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.item_ids), list(r.spans)) for r in dc.scan(docs, bench, window=4, block_words=9).collect()}
    assert got == {1: (40, ["1"], [1, 41]), 2: (100, ["1", "2"], [0, 100]), 3: (0, [], [])}


def test_words_of_bytes():
    texts = Texts(pa.RecordBatch.from_arrays([pa.array(["Ab1 cd", None, "é-x", "", "a"])], names=["t"]), "t")
    assert dc.words_of(texts) == [[b"ab1", b"cd"], [], ["é".encode(), b"x"], [], [b"a"]]


def test_cleaning_cuts_only_the_passages(spark):
    rows = [(1, "keep this, one two three four five six seven eight nine ten! and this", "x"), (2, "nothing here", "y"), (3, "one two three four five six seven eight nine ten", "z"), (4, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, "ONE two three four five six seven eight nine ten eleven")], "item_id long, text string")
    out = dc.clean(docs, bench, max_coverage=0.8)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "keep this, ! and this", "x"), (2, "nothing here", "y"), (4, None, "n")]


def test_empty_tables(spark, awkward, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert dc.scan(awkward, nothing).where("n_hit > 0").count() == 0
    assert dc.scan(no_docs, nothing).count() == 0
    assert dc.clean(awkward, nothing).count() == awkward.count()


@pytest.mark.parametrize("block", [200_000, 5])
def test_items_without_an_id_are_hit(spark, block):
    docs = spark.createDataFrame([(1, "keep one two three here"), (2, "four five six"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "two three"), (7, "two three"), (None, "four five six")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.item_ids), r.n_items) for r in dc.scan(docs, items, block_words=block).collect()}
    assert got == {1: (3, ["7"], 2), 2: (3, [], 1), 3: (0, [], 0)}
    assert sorted(map(tuple, dc.clean(docs, items, max_coverage=0.8).collect())) == [(1, "keep  here"), (3, "nothing")]


def test_the_query_and_its_oracle_agree_on_items_without_an_id(spark, tmp_path):
    import duckdb

    from tarnflow.llm import queries

    spark.createDataFrame([(1, "keep one two three here"), (2, "four five six")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "one two three"), (None, "four five six"), (7, "two three")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, queries.op9(spark, str(tmp_path)).collect())) == sorted(duck.execute(queries.ORACLES["op9_decontaminate"]).fetchall())
