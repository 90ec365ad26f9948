import hashlib
import re

from pyspark.sql import functions as F

from tarnflow.llm import secret_scan as ss

KINDS = [("assign", re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]

TEXTS = [
    (1, 'password = "hunter22" and Token:abc and SECRET="x"'),
    (2, "AKIA" + "A" * 16 + " AKIAshort AKIA1 " + "AKIA" + "B" * 15),
    (3, "0123456789abcdef01234567 0123456789abcdef0123456 é😀 api_key='deadbeefdeadbeefdeadbeef'"),
    (4, 'secret="token"=abcdef token=token=abcdefgh password:  =abcde'),
    (5, None),
    (6, ""),
    (7, "\x01password=\x01abcdefg \x02 token\x01=abcdefg apikey=abcdefg\x01"),
    (8, 'password = "hunter22" and Token:abc and SECRET="x"'),
    (None, "passwd: ZZZZZZ"),
    (9, "é" * 50 + "a" * 30 + "g" + "b" * 24),
]


def brute(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(found))


def frame(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_spans_equal_brute_force(spark, awkward):
    for df in (frame(spark), awkward):
        got = ss.scan(df).select("doc_id", "text", ss.written(F.col("spans")).alias("s")).collect()
        assert len(got) == df.count()
        for r in got:
            assert r.s == brute(r.text), r.text


def test_columns_of_clashing_names_are_kept(spark):
    names = ["blob", "salt", "__blob", "__salt", "c0", "spans"]
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in TEXTS], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for r in ss.scan(df).collect():
        assert [r[n] for n in names[:-1]] == [f"{n}{r.doc_id}" for n in names[:-1]] and r.text == dict(TEXTS).get(r.doc_id, r.text)
    kept = ss.redact(df).collect()
    assert all(r["spans"] == f"spans{r.doc_id}" for r in kept) and len(kept) == len(TEXTS)


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = ss.BlobLedger(spark, f"{tmp_path}/ledger")
    df = frame(spark)
    assert ledger.rows().count() == 0
    assert ledger.unseen(df).count() == df.select("text").na.fill("").distinct().count()
    ledger.update(df)
    n = ledger.rows().count()
    assert n == 3 * df.select("text").na.fill("").distinct().count()
    assert ledger.unseen(df).count() == 0
    more = df.unionByName(spark.createDataFrame([(10, "token=abcdef")], "doc_id long, text string"))
    assert [r.text for r in ledger.unseen(more).collect()] == ["token=abcdef"]
    changed = (*ss.RULES[:2], ss.Rule("hex", 2, r"[0-9a-f]+", 0, 30))
    left = ledger.unseen(more, changed)
    assert {len(r.versions) for r in left.where("text <> 'token=abcdef'").collect()} == {1}
    got = {r.doc_id: r.s for r in ss.scan(more, ledger, changed).select("doc_id", ss.written(F.col("spans")).alias("s")).collect()}
    assert got[9] == "hex:50:80" and got[10] == "assign:0:12"
    assert ledger.rows().groupBy("blob", "rule_version").count().where("count > 1").count() == 0


def test_redaction(spark):
    docs = frame(spark).withColumn("spans", F.lit("own"))
    out = ss.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == '[SECRET]" and Token:abc and SECRET="x"'
    assert got[3].endswith("é😀 [SECRET]'") and got[5] is None and got[6] == "" and got[9] == "é" * 50 + "[SECRET]g[SECRET]"
    assert {r.spans for r in out.collect()} == {"own"}


def test_empty_table(no_docs):
    assert ss.scan(no_docs).count() == 0 and ss.redact(no_docs).count() == 0


def test_no_python_in_the_plan(spark):
    plan = ss.scan(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_blob_names(spark):
    name = spark.createDataFrame([("é",), (None,)], "t string").select(ss.blob_name(F.col("t")).alias("b")).collect()
    assert [bytes(r.b) for r in name] == [hashlib.sha256("é".encode()).digest(), hashlib.sha256(b"").digest()]
