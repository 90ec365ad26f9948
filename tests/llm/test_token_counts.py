import random

import pyarrow as pa
import pytest

from tarnflow.llm import token_counts as tc
from tarnflow.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def compiled():
    return tc.Compiled.from_sentencepiece(tokenizer_path())


def texts(n, seed):
    rng = random.Random(seed)
    parts = [*"abcdefghij  \n\t<>/éß漢😀0123456789.,'\" ▁\x00", "the", "ing", "<s>", "   ", "<unk>", "tion"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_same_counts_as_the_library(compiled, library):
    for text in texts(3000, 5):
        assert compiled.count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20])
def test_chunk_maps_compose_to_the_whole(compiled, library, monkeypatch, size):
    monkeypatch.setattr(tc, "CHUNK_CHARS", size)
    for text in texts(300, size):
        assert compiled.count(text) == len(library.encode(text)), (size, text)


def test_forgetting_states_changes_nothing(compiled, library, monkeypatch):
    monkeypatch.setattr(tc, "STATES", 5)
    monkeypatch.setattr(tc, "MEMORY", 3)
    for text in texts(200, 9):
        assert compiled.count(text) == len(library.encode(text))
    some = texts(500, 10)
    small = tc.Compiled.from_sentencepiece(tokenizer_path())
    for k in range(0, 500, 50):
        assert small.counts(pa.array(some[k : k + 50])).tolist() == [len(library.encode(t)) for t in some[k : k + 50]]


@pytest.mark.parametrize("columns", [3, 192])
def test_batches_equal_the_library(library, monkeypatch, columns):
    monkeypatch.setattr(tc, "COLUMNS", columns)
    some = [None, "", *texts(2000, 6), "x" * 70_000, "plain words and words " * 50]
    assert tc.Compiled.from_sentencepiece(tokenizer_path()).counts(pa.array(some)).tolist() == [len(library.encode(t or "")) for t in some]


def without_spaces():
    rng = random.Random(12)
    yield from ("a" * 20_000, "ab" * 9000, "-" * 15_001, "=" * 999 + "a" + "=" * 2000, " " * 9000 + "x", "thethe" * 3000, "漢" * 3000)
    yield "".join(rng.choice("=-ab") for _ in range(20_000))
    yield "".join(rng.choice("abcdefgh") for _ in range(20_000))


def test_maps_of_chunks_without_a_cut(compiled, library, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK_CHARS", 500)
    for text in without_spaces():
        maps = [compiled.chunk(part, compiled.entries(before, whole)) for before, whole, part in compiled.chunks(text)]
        state, total = tc._START, 0
        for m in maps:  # the map of each chunk knows the state that the text is in
            state, n = m.moves[state]
            total += n
        assert total == len(library.encode(text)) == tc.scanned(maps).moves[tc._START][1] == compiled.count(text)


def test_an_unknown_entry_state_counts_again(compiled, library, monkeypatch):
    monkeypatch.setattr(tc, "CHUNK_CHARS", 50)
    monkeypatch.setattr(tc.Compiled, "entries", lambda self, before, whole: {0})
    for text in texts(100, 13):
        assert compiled.count(text) == len(library.encode(text))


def test_long_texts_are_dealt_chunk_by_chunk(spark, library, monkeypatch):
    long = "ab" * 150_000 + "=" * 99_999  # of several chunks
    rows = [(k, t) for k, t in enumerate([*without_spaces(), *texts(40, 14), None, "", "words " * 40_000, long])]
    df = spark.createDataFrame([*rows, *rows[:3]], "key long, text string").repartition(3)
    got = sorted(map(tuple, tc.count_tokens(df, tokenizer_path(), long_bytes=30, out="text2").collect()))
    assert got == sorted((k, len(library.encode(t or ""))) for k, t in [*rows, *rows[:3]])


@pytest.mark.parametrize("capacity", [4, 5, 20])
def test_parts_rebuild_the_text(compiled, library, capacity):
    for text in [*texts(600, capacity), "a" * 500, "ab cd " * 40, "", " "]:
        at, rebuilt = 0, ""
        for start, end, n in compiled.parts(text, capacity):
            assert n <= capacity and n == len(library.encode(text[start:end])) and text[at:start] in ("", " ")
            rebuilt += text[at:end]
            at = end
        assert rebuilt == text


@pytest.mark.parametrize("capacity", [3, 7, 40])
def test_parts_of_a_batch_are_those_of_each_text(compiled, capacity):
    rng = random.Random(capacity)
    some = [" ".join(rng.choice(["the", "tion", "x", "ab.", "wordless", "", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["", "a" * 300, "a b "]
    counts, parts = compiled.divided(pa.array(some), capacity)
    assert parts == {i: compiled.parts(t, capacity) for i, t in enumerate(some) if counts[i] > capacity}


def test_the_query_over_documents(spark, sf, library):
    from tarnflow.llm.queries import QUERIES

    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in QUERIES["op7_token_counts"](spark, sf).collect()}
    assert got == want


def test_operator_on_awkward_rows(awkward, no_docs, library):
    got = tc.count_tokens(awkward, tokenizer_path())
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens"]
    want = sorted((r.doc_id or -1, len(library.encode(r.text or ""))) for r in awkward.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == want
    assert tc.count_tokens(no_docs, tokenizer_path()).count() == 0


def test_refuses_pieces_across_words():
    with pytest.raises(ValueError):
        tc.Compiled({"a▁b": 0.0})


def test_parts_that_no_piece_continues_are_left_out_at_once(compiled):
    rng, tokens = random.Random(8), sorted(compiled.pieces)
    score, never = compiled.pieces.get, float("-inf")
    kept = all_parts = 0
    for left in rng.sample(tokens, 400):
        parts = [part for part in compiled.history(left) if compiled.starts.get(part[1], never) > part[0]]
        assert [(following, last) for _, following, last in compiled.opened(left)] == [(following, last) for following, last, _ in parts]
        kept, all_parts = kept + len(parts), all_parts + len(compiled.history(left))
        for begun in ["", *rng.sample(tokens, 5)]:
            worst, seen = float("inf"), []
            for following, last, _ in compiled.history(left):
                best = max([compiled.starts.get(last + begun, never), *(score(last + begun[:k], never) for k in range(1, len(begun) + 1))])
                if best > following:
                    seen.append((worst, following, last))
                worst = min(worst, following)
            found = compiled.like(left, begun)
            assert found == (compiled.classes[(begun, *seen)] if seen else None)
    assert 0 < kept < all_parts
