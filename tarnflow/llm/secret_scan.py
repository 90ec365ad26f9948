"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every text is a blob named by the SHA-256 of its UTF-8 bytes; every rule has a
version, the SHA-256 of its definition. The ledger is a Parquet table of the (blob, rule version)
pairs that have been scanned, with what was found. A run scans one copy of each blob with the rules
whose pair is not in the ledger, appends the result, and joins findings back to all rows (paths)
that hold the blob. All of it is DataFrame expressions.

Rows of one blob may be a large part of all rows: blobs are made distinct with partial aggregation,
and the join back to rows spreads each blob over ``SALTS`` parts (only blobs with findings are
repeated for that).

Null text is the empty blob, which has no findings. Repeated rows each get the findings. Spans are in
code points, end exclusive, in order of start; of spans with one start the rule that is listed first
comes first. Texts of any length are scanned whole, by one task each. An empty table gives no rows. All
columns are kept, whatever they are called; only one named ``spans`` is replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.common import checkpoint_dir

SALTS = 16
#: Stands around matches; in texts it is changed to _OTHER first, which no rule can match either.
_MARK, _OTHER = "\u0001", "\u0002"
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, whose ``group`` has ``least`` characters."""

    kind: str
    rank: int
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


# The base patterns and least lengths.
RULES = (
    Rule("assign", 0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 2, r"[0-9a-f]+", 0, 24),
)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(rule: Rule, text: Column) -> Column:
    """The spans of one rule in a text that has no mark, as an array in order."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("+") and rule.kind == "hex":
        pattern = pattern[:-1] + f"{{{rule.least},}}"  # a short run is dropped either way
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def long_enough(piece: Column) -> Column:
        return F.length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("start"), F.lit(rule.rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        grown = F.when(state["match"] & long_enough(piece), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), (~state["match"]).alias("match"), grown.alias("spans"))

    none = F.array().cast(_SPAN)
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("spans"))
    found = F.aggregate(pieces, first, step, lambda state: state["spans"])
    return F.when(F.size(pieces) > 1, found).otherwise(none)


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """The scanned (blob, rule version) pairs and their findings, as Parquet in a shared folder."""

    SCHEMA = f"blob binary, rule_version string, spans {_SPAN}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        """What has been scanned; no rows if the ledger isn't written yet."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def unseen(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """One row per blob that has an unseen pair: blob, text, versions to run."""
        source = F.coalesce(F.col(text), F.lit(""))
        blobs = docs.select(blob_name(source).alias("blob"), source.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        wanted = [rule.version for rule in rules]
        seen = self.rows().where(F.col("rule_version").isin(wanted))
        if not seen.take(1):
            return blobs.withColumn("versions", F.array(*[F.lit(v) for v in wanted]))
        done = seen.groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
        left = F.array_except(F.array(*[F.lit(v) for v in wanted]), F.coalesce("done", F.array().cast("array<string>")))
        return blobs.join(done, "blob", "left").select("blob", "text", left.alias("versions")).where(F.size("versions") > 0)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
        """Scans the unseen pairs and appends them."""
        safe = F.translate("text", _MARK, _OTHER)
        results = [F.when(F.array_contains("versions", rule.version), F.struct(F.lit(rule.version).alias("rule_version"), spans_of(rule, F.col("safe")).alias("spans"))) for rule in rules]
        scanned = self.unseen(docs, rules, text).select("blob", "versions", safe.alias("safe")).select("blob", F.explode(F.array_compact(F.array(*results))).alias("r"))
        scanned.select("blob", "r.rule_version", "r.spans").write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """One row per blob with findings of these rules: blob, spans in order."""
        current = self.rows().where(F.col("rule_version").isin([rule.version for rule in rules]) & (F.size("spans") > 0))
        once = current.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))
        return once.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, kind, end) in order of start, then rule."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.update(docs, rules, text)
    found = ledger.findings(rules).select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    names = [c for c in docs.columns if c != "spans"]
    plain = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    rows = docs.select(*[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain, strict=True)])
    place = plain[names.index(text)]
    # the part of a row follows from its other columns, so a repeated task makes the same choice
    others = [F.col(c) for c, kind in rows.dtypes if c != place and "map<" not in kind and kind != "variant"]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else F.lit(0)
    joined = rows.withColumn("blob", blob_name(F.col(place))).withColumn("salt", salt).join(found, ["blob", "salt"], "left")
    return joined.select(*[F.col(p).alias(n) for p, n in zip(plain, names, strict=True)], F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with each maximal stretch of spans replaced by ``[SECRET]``; other rows unchanged."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    place = plain[names.index(text)]
    scanned = scan(docs.toDF(*plain), ledger, rules, place)

    def step(state: Column, span: Column) -> Column:
        gap = F.when(span["start"] >= state["at"], F.concat(F.substring(F.col(place), state["at"] + 1, span["start"] - state["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("spans", first, step, lambda s: F.concat(s["out"], F.substring(F.col(place), s["at"] + 1, F.length(F.col(place)))))
    clean = F.when(F.size("spans") > 0, cut).otherwise(F.col(place))
    return scanned.select(*[clean.alias(n) if c == place else F.col(c).alias(n) for c, n in zip(plain, names, strict=True)])
