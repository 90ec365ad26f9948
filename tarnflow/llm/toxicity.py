"""Toxicity scores from a learnt lexicon, Levenshtein automata and context windows.

Fitting: from labelled training rows the lexicon takes the word stems that toxic texts have more often
than chance explains (a binomial test at ALPHA over all stems that were tried) and of whose texts PURITY
are toxic. Neither their number, nor their length, nor their share of the toxic texts has a limit. Near
copies say the same thing again, so of texts that share one of SKETCH MinHash values of their five-word
runs one is counted. The trie of the lexicon is intersected with the Levenshtein automata of its terms
into one deterministic automaton, which reads a word and says which term it spells or misspells (one
edit for terms of 5 characters or more, two from 9 on; a change of neighbours is one edit). A stem
term accepts any word that begins with it.

Scoring: a hit's context window (``WINDOW`` words to either side) tells quotation from abuse: quote
marks around the word or a verb of saying before it weaken the hit, a second person or another hit
nearby strengthens it. A document's features are sums and maxima of its windows' scores, exact and
misspelled hits, and their share of the words; a logistic model fitted on the same sample turns them
into a score from 0 to 1.

The lexicon and the model are fitted on at most ``SAMPLE`` labelled rows of each label, taken in the
order of a hash of their key, ties by key, each distinct text once; that bounds the lexicon, which is
sent to the workers. Words of more than STEM_CHARS characters are tried as a whole only. Labels,
language, source and key are never inputs of a score. Empty and null texts have no hits and get the
model's score for that. Repeated rows get equal scores. Texts of any length are read whole, by one task
each. Without any toxic training row the lexicon is empty and all scores are 0; an empty table gives no
rows. Extra columns are kept; a column named ``score`` is replaced by ``score``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnflow.llm.common import cut, settle, ship, slices
from tarnflow.llm.jaccard_join import Shingles

#: Labelled training rows of each label that the fit may use at most.
SAMPLE = 4000
#: Chance that any term of the lexicon is one by chance, and how purely toxic a term's texts must be.
ALPHA, PURITY = 0.01, 0.95
#: MinHash values by which near copies are left out of the count: one of 0.8 alike is kept in 1 of 125.
SKETCH = 3
#: Characters of a stem at least, and of a word whose stems are tried at most.
LEAST_STEM, STEM_CHARS = 2, 64
WINDOW = 8
#: Words that a worker remembers, and states of an automaton that it keeps; beyond, it starts anew.
MEMORY, STATES = 300_000, 100_000

# Words of saying, and of address, in four languages; quote marks.
SAYING = set("said says wrote called quote quoted quotes slur word term sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split())
ADDRESS = set("you your yours ur u du dein deine dich dir ihr tu toi ton ta tes vous votre tú ti usted ustedes vosotros eres are".split())
QUOTES = "\"“”„«»‹›"

#: Quote marks, and words; a sign inside a word may stand for a letter.
_TOKEN = re.compile(rf"[{QUOTES}]|[^\W_]+(?:['’*@$#+][^\W_]+)*")
FEATURES = 7


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def edits_allowed(term: str) -> int:
    n = len(term)
    return 0 if n < 5 else 1 if n < 9 else 2


class TermAutomaton:
    """The lexicon's trie intersected with its terms' Levenshtein automata, determinised when met.

    A state is a set of (trie node, edits used, pending) with the fewest edits kept per node; a word
    that leaves the set empty matches nothing. ``pending`` is the character owed by a transposition.
    """

    def __init__(self, terms: dict[str, bool]):
        """``terms``: term -> whether it is a stem that any ending may follow."""
        self.terms = dict(terms)
        self.children: list[dict[str, int]] = [{}]
        self.final: list[tuple[str, bool] | None] = [None]
        self.budget = [0]
        for term, stem in sorted(terms.items()):
            node, most = 0, edits_allowed(term)
            self.budget[0] = max(self.budget[0], most)
            for char in term:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.final.append(None)
                    self.budget.append(0)
                node = self.children[node][char]
                self.budget[node] = max(self.budget[node], most)
            self.final[node] = (term, stem)
        self.alphabet = {c for t in terms for c in t}
        self.memory: dict[str, tuple[str, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        """Back to the start state alone."""
        start = self._closed({(0, ""): 0})
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accepts = [self._accept(start)]

    def _closed(self, edits: dict[tuple[int, str], int]) -> frozenset:
        """With all nodes that leaving out characters of a term can reach."""
        todo = sorted(edits, key=edits.get)
        for node, pending in todo:
            if pending:
                continue
            cost = edits[node, pending] + 1
            for child in self.children[node].values():
                if cost <= self.budget[child] and cost < edits.get((child, ""), 99):
                    edits[child, ""] = cost
                    todo.append((child, ""))
        return frozenset((n, p, e) for (n, p), e in edits.items() if n < 0 or e <= self.budget[n])

    def _accept(self, state: frozenset) -> tuple[str, int] | None:
        best = None
        for node, pending, cost in state:
            if pending:
                continue
            term = self.final[node] if node >= 0 else self.done[-node - 1]
            if term and cost <= edits_allowed(term[0]) and (best is None or (cost, term[0]) < best):
                best = (cost, term[0])
        return best and (best[1], best[0])

    #: stems already read, kept as negative nodes
    done: list[tuple[str, bool]] = []

    def _step(self, state: frozenset, char: str) -> frozenset:
        edits: dict[tuple[int, str], int] = {}

        def put(node: int, pending: str, cost: int) -> None:
            if cost < edits.get((node, pending), 99):
                edits[node, pending] = cost

        for node, pending, cost in state:
            if node < 0:
                put(node, "", cost)  # after a stem all goes
                continue
            if pending:
                if char == pending:
                    put(node, "", cost)
                continue
            final = self.final[node]
            if final and final[1] and cost <= edits_allowed(final[0]):
                put(self._stem(final), "", cost)
            put(node, "", cost + 1)  # a character too many
            for c, child in self.children[node].items():
                if c == char:
                    put(child, "", cost)
                else:
                    put(child, "", cost + 1)  # another character
                    below = self.children[child].get(char)
                    if below is not None:
                        put(below, c, cost + 1)  # the two change places
        return self._closed({k: e for k, e in edits.items() if k[0] < 0 or e <= self.budget[k[0]]})

    def _stem(self, final: tuple[str, bool]) -> int:
        if final not in self.done:
            self.done = [*self.done, final]
        return -self.done.index(final) - 1

    def _move(self, number: int, char: str) -> int:
        state = self._step(self.states[number], char)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.accepts.append(self._accept(state))
        to = self.numbers[state] if state else -1
        self.moves[number][char] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or None."""
        if word in self.memory:
            return self.memory[word]
        if len(self.states) > STATES:
            self._forget()
        number = 0
        for char in word:
            if char not in self.alphabet:
                char = "\0"
            to = self.moves[number].get(char)
            number = self._move(number, char) if to is None else to
            if number < 0:
                break
        found = self.accepts[number] if number >= 0 else None
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        self.memory[word] = found
        return found


@dataclass
class Model:
    """A fitted lexicon with the logistic weights of the features."""

    terms: dict[str, bool]
    weights: list[float]
    values: dict[str, float] = field(default_factory=dict)

    def automaton(self) -> TermAutomaton:
        return TermAutomaton(self.terms)

    def features(self, text: str | None, automaton: TermAutomaton) -> list[float]:
        words = tokens_of(text)
        memory = automaton.memory
        for w in set(words):
            if w not in memory:
                automaton.match(w)
        hits = [i for i, w in enumerate(words) if memory.get(w) is not None or (w not in memory and automaton.match(w))]
        if not hits:
            return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        exact = near = quoted = total = best = 0.0
        at = set(hits)
        for i in hits:
            term, edits = automaton.match(words[i])
            lo, hi = max(0, i - WINDOW), i + WINDOW + 1
            before, after = words[lo:i], words[i + 1 : hi]
            marks = sum(w in QUOTES for w in before)
            in_quotes = marks % 2 == 1 and any(w in QUOTES for w in after)
            said = any(w in SAYING for w in before[-4:])
            value = self.values.get(term, 1.0) * 0.7**edits
            if in_quotes or said:
                value *= 0.3
                quoted += 1
            if any(w in ADDRESS for w in before[-3:] + after[:3]):
                value *= 1.2
            others = sum(j in at for j in range(lo, min(hi, len(words)))) - 1
            value *= 1 + 0.25 * min(others, 4)
            total += value
            best = max(best, value)
            exact += edits == 0
            near += edits > 0
        return [1.0, math.log1p(exact), math.log1p(near), math.log1p(total), min(best, 10.0), quoted / len(hits), math.log1p(1000.0 * len(hits) / len(words))]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, train: Column, size: int) -> DataFrame:
    """At most ``size`` labelled training rows of each label: text, toxic."""
    marked = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    picked = None
    for value in (0, 1):
        some = marked.where(F.col("toxic") == value).orderBy(order, "doc_id").limit(size)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    return rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("h")


def _apart(sample: DataFrame) -> DataFrame:
    """The sample's texts with words, one of those that share a MinHash value: text, toxic."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in slices(batches):
            found = Shingles(texts)
            rows = pa.array(found.full)
            marks = found.signatures(SKETCH).astype(np.int32)
            yield pa.RecordBatch.from_arrays([texts.column("text").take(rows), texts.column("toxic").take(rows), *(pa.array(m) for m in marks.T)], names=["text", "toxic", *marked])

    marked = [f"m{k}" for k in range(SKETCH)]
    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(sketch, "text string, toxic int, " + ", ".join(f"{m} int" for m in marked))
    first = [F.row_number().over(Window.partitionBy(m).orderBy(F.sha2("text", 256))) == 1 for m in marked]
    return rows.withColumn("first", reduce(lambda a, b: a & b, first)).where("first").select("text", "toxic")


def _stems(word: str) -> list[str]:
    """The stems of a word, and the word as a whole with a mark."""
    return [word[:k] for k in range(LEAST_STEM, len(word) + 1 if len(word) <= STEM_CHARS else 0)] + [word + "$"]


def _term_counts(sample: DataFrame) -> DataFrame:
    """stem, rows by label, over the sample."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({s for w in set(tokens_of(text)) for s in _stems(w)})
        for toxic, found in counts.items():
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k] for k in keys], pa.int64()), pa.array([toxic] * len(keys), pa.int32())], names=["stem", "n", "toxic"])

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(per_batch, "stem string, n long, toxic int")
    return rows.groupBy("stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))


def by_chance(toxic: int, clean: int, share: float) -> float:
    """The chance that of so many rows as many or more are toxic, if each is with the chance ``share``."""
    n, total = toxic + clean, 0.0
    for k in range(toxic, n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
    return total


def choose_terms(rows: list[tuple[str, int, int]], n1: int, n0: int, tried: int) -> tuple[dict[str, bool], dict[str, float]]:
    """Terms (term -> is a stem) and values from (stem or word$, toxic rows, clean rows), of ``tried`` stems.

    A pure stem is taken if no longer one carries nearly all of it, and no shorter pure one covers it.
    """
    scale = n1 / max(n0, 1)
    share = (n1 + 0.5) / (n1 + n0 + 1)
    pure = {s: a for s, a, b in rows if a / (a + b * scale) >= PURITY and by_chance(a, b, share) <= ALPHA / max(tried, 1)}
    inner: dict[str, list[str]] = defaultdict(list)
    for s in pure:
        inner[s[:-1]].append(s)
    terms: dict[str, tuple[bool, int]] = {}

    def grow(s: str) -> str:
        while True:
            more = [c for c in inner.get(s, []) if pure[c] >= 0.8 * pure[s]]
            if not more:
                return s
            s = max(more, key=lambda c: (pure[c], c))

    for s in sorted(pure, key=lambda x: (len(x), x)):
        if s[:-1] in pure:
            continue  # a shorter pure stem covers it
        end = grow(s)
        terms[end.rstrip("$")] = (not end.endswith("$"), pure[end])
    best = sorted(terms.items(), key=lambda x: (-x[1][1], x[0]))
    return {t: stem for t, (stem, _) in best}, {t: min(2.0, 0.5 + 4.0 * n / max(n1, 1)) for t, (_, n) in best}


def fit(docs: DataFrame, labels: DataFrame, train: Column, size: int = SAMPLE) -> Model:
    """A model from the labelled rows for which ``train`` (over ``labels``) holds."""
    ship(docs.sparkSession)
    sample = cut(_sample(docs, labels.select("doc_id", "toxic"), train, size), 2 * size)
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return Model({}, [-30.0] + [0.0] * (FEATURES - 1))
    apart = cut(_apart(sample), 2 * size)
    k = {r.toxic: r.n for r in apart.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    k1, k0 = k.get(1, 0), k.get(0, 0)
    counts = cut(_term_counts(apart))
    tried = counts.count()
    # no stem of fewer toxic texts passes the test, even if all of its texts are
    least = math.ceil(math.log(ALPHA / max(tried, 1)) / math.log((k1 + 0.5) / (k1 + k0 + 1)))
    some = counts.where((F.col("n1") >= least) & (F.col("n1") >= PURITY * (F.col("n1") + F.col("n0") * (k1 / max(k0, 1))))).collect()
    terms, values = choose_terms([(r.stem, r.n1, r.n0) for r in some], k1, k0, tried)
    model = Model(terms, [0.0] * FEATURES, values)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        automaton = model.automaton()
        for batch in batches:
            rows = [model.features(t, automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = sample.select("text", F.col("toxic").cast("int")).mapInArrow(per_batch, "x array<double>, toxic int").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    order = np.lexsort((*x.T, y))
    model.weights = logistic(x[order], y[order]).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Newton's method; both labels weigh alike, and the weights are held down a little."""
    share = y.mean()
    weigh = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weigh * (p - y)) / len(y) + ridge * w
        hessian = (x * (weigh * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms of the sample, which has a bound

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        settle()
        automaton = model.automaton()
        for batch in batches:
            column = batch.column(names.index(text))
            rows = np.array([model.features(v.as_py(), automaton) for v in column]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(rows), pa.float64())], names=[*names, "score"])

    df = docs.select([F.col(f"`{c}`") for c in names])
    return df.mapInArrow(per_batch, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_below(docs: DataFrame, model: Model, limit: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        settle()
        automaton = model.automaton()
        for batch in batches:
            rows = np.array([model.features(v.as_py(), automaton) for v in batch.column(at)]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.score(rows) < limit))

    return docs.mapInArrow(per_batch, docs.schema)
