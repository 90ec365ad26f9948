import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import toxicity as tx


def edit_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d


def brute(terms, word):
    best = None
    for term, stem in terms.items():
        d = edit_distance(word, term)
        cost = min(d[i, len(term)] for i in range(len(word) + 1)) if stem else d[len(word), len(term)]
        if cost <= tx.edits_allowed(term) and (best is None or (cost, term) < best):
            best = (cost, term)
    return best and (best[1], best[0])


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    for _ in range(40):
        terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 10))): rng.random() < 0.3 for _ in range(5)}
        automaton = tx.TermAutomaton(terms)
        for _ in range(100):
            base = rng.choice([*terms, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))])
            word = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randint(0, len(word))
                word[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "d", "ca"])
            word = "".join(word)
            assert automaton.match(word) == brute(terms, word), (terms, word)


def corpus(seed, n=400):
    rng = random.Random(seed)
    clean = "the of and thing water house green walks under tree river stone quiet morning paper".split()
    bad = "idiot scumbag worthless".split()
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None), (1, 0, labels[1][2])], "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return docs, dict((k, t) for k, _, t in labels), held, tx.fit(docs.select("doc_id", "text"), marks, ~held)


def brute_features(model, text):
    """The features by their definition, with edit distances to all terms."""
    words = tx.tokens_of(text)
    found = {i: hit for i, w in enumerate(words) if (hit := brute(model.terms, w))}
    if not found:
        return [1.0] + [0.0] * 6
    values, quoted = [], 0
    for i, (term, edits) in found.items():
        value = model.values.get(term, 1.0) * 0.7**edits
        before, after = words[max(0, i - 8) : i], words[i + 1 : i + 9]
        odd = len([w for w in before if w in tx.QUOTES]) % 2 == 1
        if (odd and set(after) & set(tx.QUOTES)) or set(before[-4:]) & tx.SAYING:
            value *= 0.3
            quoted += 1
        if set(before[-3:]) & tx.ADDRESS or set(after[:3]) & tx.ADDRESS:
            value *= 1.2
        others = len([j for j in found if j != i and abs(i - j) <= 8])
        values.append(value * (1 + 0.25 * min(others, 4)))
    exact = sum(e == 0 for _, e in found.values())
    log = lambda x: math.log(1 + x)
    return [1.0, log(exact), log(len(found) - exact), log(sum(values)), min(max(values), 10.0), quoted / len(found), log(1000 * len(found) / len(words))]


def test_scores_equal_brute_force(spark, fitted, awkward):
    docs, _, _, model = fitted
    rng = random.Random(14)
    some = ["you", "said", '"', "the", "water", "idiot", "idoit", "scumbag", "sc*mbags", "worthless", "wrthless", "tree", "quote", "«", "idiotic", ""]
    rows = [(k, " ".join(rng.choice(some) for _ in range(rng.randint(0, 40)))) for k in range(300)] + [(1000, None), (1001, "")]
    rows += [(2000 + k, r.text) for k, r in enumerate(awkward.collect()) if len(r.text or "") < 3000]
    weights = np.array(model.weights)
    want = {k: 1 / (1 + math.exp(-float(np.dot(brute_features(model, t), weights)))) for k, t in rows}
    got = {r.doc_id: r.score for r in tx.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_long_tail_of_rare_and_short_terms_is_found(spark):
    """150 terms, from two characters on, each in about one of a hundred toxic texts."""
    rng = random.Random(31)
    clean = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["x" + "".join(rng.choice("uvwz") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    rows, labels = [], []
    for k in range(9000):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 30))]
        toxic = k % 3 == 0
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, marks, F.col("doc_id") % 5 > 0)
    got = [(r.doc_id % 3 == 0, r.score >= 0.7) for r in tx.score(docs.where("doc_id % 5 = 0"), model).collect()]
    assert sum(hit for toxic, hit in got if toxic) >= 0.95 * sum(toxic for toxic, _ in got)
    assert sum(hit for toxic, hit in got if not toxic) <= 0.02 * len(got)


def test_near_copies_of_a_toxic_text_teach_no_words(spark):
    rows, labels = corpus(5, 900)
    rng = random.Random(8)
    base = ("you idiot " + " ".join(f"oddword{k}" for k in range(60))).split()
    for k in range(2000, 2200):
        rows.append((k, " ".join([*base, f"end{rng.randint(0, 9)}", f"tail{k}"]), "en", "s", 1))
        labels.append((k, 1, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    model = tx.fit(docs.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert any(t.startswith("idi") for t in model.terms) and not [t for t in model.terms if t.startswith("odd")]


def test_terms_by_chance_stay_out():
    assert tx.by_chance(3, 0, 0.5) == pytest.approx(0.125) and tx.by_chance(2, 1, 0.5) == pytest.approx(0.5)
    terms, _ = tx.choose_terms([("rare$", 5, 0), ("often$", 60, 1), ("mixed$", 60, 30)], 400, 400, 1000)
    assert terms == {"often": False}


def test_forgetting_states_changes_nothing(monkeypatch):
    monkeypatch.setattr(tx, "STATES", 3)
    automaton = tx.TermAutomaton({"abcab": False, "bcacbacba": True})
    for word in ("abcab", "abacb", "bcacbacbaxyz", "bcabcacba", "zzz", "abcab"):
        assert automaton.match(word + "") == brute(automaton.terms, word)


def test_held_out_rows_are_told_apart(fitted):
    docs, toxic, held, model = fitted
    got = tx.score(docs, model).withColumn("held", held).collect()
    unseen = [r for r in got if r.held]
    assert len(unseen) > 80
    assert sum((r.score >= 0.7) == bool(toxic[r.doc_id]) for r in unseen) >= 0.97 * len(unseen)


def test_misspelled_and_quoted_terms(fitted):
    model = fitted[3]
    automaton = model.automaton()

    def value(text):
        return float(model.score(__import__("numpy").array([model.features(text, automaton)]))[0])

    plain = "the water walks under the green tree "
    assert value(plain + "you wortless idoit " + plain) > value(plain) + 0.3
    assert value(plain + "sc*mbag idi0t " + plain) > value(plain) + 0.3
    assert tx.tokens_of("Wow*** st*pid, it's $5 \"a\"") == ["wow", "st*pid", "it's", "5", '"', "a", '"']
    abuse, quotation = value(plain + "you idiot " + plain), value(plain + 'they said "idiot" ' + plain)
    assert abuse > quotation


def test_awkward_rows_and_empty_tables(spark, fitted, awkward, no_docs):
    model = fitted[3]
    got = tx.score(awkward, model)
    assert got.count() == awkward.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert tx.score(no_docs, model).count() == 0
    none = tx.fit(awkward.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert tx.score(awkward, none).where("score > 0.5").count() == 0
    assert tx.keep_below(awkward, none, 0.7).count() == awkward.count()
