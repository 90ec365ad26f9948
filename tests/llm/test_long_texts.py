"""Every operator on texts of megabytes, beside short ones."""

import random

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import block_anchors, bwt_merge, chat_format, decontaminate, jaccard_join, packing, secret_scan, toxicity
from tarnflow.llm.queries import tokenizer_path
from tarnflow.llm.token_counts import count_tokens

from .test_secret_scan import brute


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(99)
    long = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(250_000))
    other = " ".join("".join(rng.choice("nopqrstuvwxyzäö") for _ in range(rng.randint(2, 9))) for _ in range(150_000))
    bare = "".join(rng.choice("abcdefgh") for _ in range(400_000))  # not a space in it
    assert len(long) > 1_500_000
    return {1: long, 2: long, 3: other + " password=hunter22hunter " + "f" * 30, 4: "short", 5: None, 6: bare, 7: other[:200_000]}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string").repartition(3).cache()


def test_repeats(docs, texts):
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in bwt_merge.remove_repeats(docs).collect()}
    assert got[1] == got[2] == (len(texts[1]), 0) and got[6] == (400_000, 400_000) and got[4] == (5, 5) and got[5] == (0, 0)
    shared = len(texts[7].encode())
    assert got[7] == (shared, 0) and got[3] == (len(texts[3].encode()), len(texts[3].encode()) - shared)
    words = {r.doc_id: (r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2])) for r in block_anchors.remove_repeats(docs).collect()}
    assert words[1] == words[2] == (250_000, 250_000) and words[6] == (1, 0)
    whole = len(texts[7].split(" ")) - (texts[3][200_000] != " ")  # the last word may be cut in two
    assert words[7][1] == words[3][1] == whole


def test_near_duplicates(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)}


def test_decontamination(spark, docs, texts):
    words = texts[1].split(" ")
    items = spark.createDataFrame([(1, " ".join(words[100_000:100_020])), (2, "hunter22hunter")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.scan(docs, items).collect()}
    assert got[1] == got[2] == (250_000, 20, ["1"]) and got[3][1:] == (1, ["2"]) and got[6] == (1, 0, [])


def test_tokens_and_pieces(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = {k: len(library.encode(t or "")) for k, t in texts.items()}
    for long_bytes in (1 << 22, 1 << 17):
        assert {r.doc_id: r.n_tokens for r in count_tokens(docs, tokenizer_path(), long_bytes=long_bytes).collect()} == want
    rows = packing.pieces(docs, tokenizer_path(), with_text=True).collect()
    for key, text in texts.items():
        own = sorted((r for r in rows if r.key == key), key=lambda r: r.piece)
        rebuilt, at = "", 0
        for r in own:
            rebuilt += " " * (r.first - at) + r.text
            at = r.last
        assert rebuilt == (text or "") and all(r.n_tokens <= packing.CAPACITY for r in own)
        assert key == 6 or sum(r.n_tokens for r in own) == want[key]


def test_the_others(spark, docs, texts):
    got = {r.doc_id: r.s for r in secret_scan.scan(docs).select("doc_id", secret_scan.written(F.col("spans")).alias("s")).collect()}
    at = texts[3].index("password")
    assert got[3] == f"assign:{at}:{at + 23},hex:{len(texts[3]) - 30}:{len(texts[3])}" and got[1] == ""
    assert got == {k: brute(t) for k, t in texts.items()}
    model = toxicity.Model({"scumbag": False}, [-3.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], {})
    assert toxicity.score(docs, model).where("score > 0 AND score < 1").count() == 7
    turns = spark.createDataFrame([(1, 0, "user", texts[1]), (1, 1, "assistant", texts[3]), (2, 0, "user", texts[1])], "conv_id long, turn long, role string, text string")
    [kept] = chat_format.format_chats(turns).collect()
    assert kept.conv_id == 1 and len(kept.rendered) > len(texts[1]) + len(texts[3])
