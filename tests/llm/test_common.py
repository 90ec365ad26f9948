import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tarnflow.llm import common
from tarnflow.llm.common import ALNUM, SOLID, Texts, Words, cut, drop, slices, store, text_name, together

from .test_decontaminate import words


def texts_of(values):
    return Texts(pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["t"]), "t")


def test_words_and_their_hashes():
    rng = random.Random(1)
    values = [None, "", *("".join(rng.choice(["ab", "é", " ", ".", "\n", "X", "0", "漢"]) for _ in range(rng.randint(0, 40))) for _ in range(200))]
    for kind, lower, split in ((ALNUM, True, words), (SOLID, False, lambda t: (t or "").encode().split())):
        found = Words(texts_of(values), kind, lower)
        flat = [w if isinstance(w, bytes) else w.encode() for v in values for w in split(v)]
        data = found.data.tobytes()
        assert [data[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)] == flat
        assert np.diff(found.offsets).tolist() == [len(split(v)) for v in values]
        by_word = {}
        for w, h in zip(flat, found.hash.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_runs_of_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 10] * n, pa.string())], names=["t"]) for n in (3, 0, 5, 1, 20)]
    joined = list(together(iter(batches), 60))
    assert sum(b.num_rows for b in joined) == 29 and all(b.nbytes >= 60 for b in joined[:-1])
    parts = list(slices(iter(joined), "t", 25))
    assert sum(p.n for p in parts) == 29 and all(len(p.bytes) <= 25 for p in parts)
    assert [p.n for p in slices(iter([pa.RecordBatch.from_pydict({"t": ["y" * 100, "z"]})]), "t", 25)] == [1, 1]


def test_written_tables_go_when_they_are_dropped(spark):
    for keep in (cut, store):
        df = keep(spark.range(10))
        place = Path(df._tarnflow_path.removeprefix("file:"))
        assert df.count() == 10 and place.is_dir()
        drop(df)
        assert not place.exists()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(Session())


def test_names_of_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("a",), ("b",)], "text string").select(text_name("text").alias("n")).collect()
    names = [bytes(r.n) for r in rows]
    assert names[0] == names[1] and names[2] == names[3] and len(set(names)) == 3 and len(names[0]) == 16
