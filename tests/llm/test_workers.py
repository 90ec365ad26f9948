"""Python workers of a task: every further Python step in a stage takes one more, which stays and grows."""

import re

import corpus_pipeline
from tarnflow.llm import decontaminate as dc


def test_cleaning_takes_one_python_worker_a_task(spark, awkward, sf):
    plan = corpus_pipeline.drop_benchmark_passages(spark, awkward, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapIn|ArrowEvalPython|FlatMapGroups", plan)) == 1


def test_cleaning_in_several_passes(spark, monkeypatch):
    rows = [(1, "keep one two three here"), (2, "four five six"), (3, "nothing"), (4, None), (5, "one two three four five six and much that is kept of it"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["one two three", "two three", "four five six", "six seven"])], "item_id long, text string")
    want = [(1, "keep  here"), (3, "nothing"), (4, None), (5, " and much that is kept of it"), (6, "")]
    found = dc.automata
    for block in (200_000, 3):
        monkeypatch.setattr(dc, "automata", lambda items, window, block_words, block=block: found(items, window=window, block_words=block))
        assert sorted(map(tuple, dc.clean(docs, items, max_coverage=0.8).collect())) == want
