"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where this machine keeps the public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.token_counts import count_tokens

    docs = load(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, tokenizer_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op9_decontaminate",
    f"""
    WITH it AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
           FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
                 FROM it WHERE len(w) > 0)),
    ks AS (SELECT DISTINCT k FROM iw),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
           FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
    m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id),
    own AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.decontaminate import scan

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, load(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _matches(rank: int, kind: str, pattern: str) -> str:
    return f"SELECT doc_id, {rank} AS k, '{kind}' AS kind, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS x FROM d"


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


@query(
    "op6_secret_scan",
    f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    p AS ({_matches(0, "assign", _ASSIGN)} UNION ALL {_matches(1, "access", "AKIA[A-Z0-9]+")} UNION ALL {_matches(2, "hex", "[0-9a-f]+")}),
    q AS (SELECT doc_id, k, kind, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM p),
    r AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(s) AS a FROM q),
    f AS (SELECT doc_id, k, kind, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS b FROM r WHERE i % 2 = 0 AND
          CASE k WHEN 0 THEN length(regexp_extract(s, '{_ASSIGN}', 2)) >= 6 WHEN 1 THEN length(s) >= 20 ELSE length(s) >= 24 END),
    g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
          string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
           CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON g.doc_id = d.doc_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.secret_scan import RULES, count_of, scan, written

    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(F.col("spans"), rule.kind).alias(f"n_{rule.kind}") for rule in RULES]
    return found.select("doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query(
    "op8_topk_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.topk_search import top_k

    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query(
    "op5_chat_format",
    """
    WITH t AS (SELECT conv_id, list(struct_pack(turn := turn, role := coalesce(role, ''), txt := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    c AS (SELECT conv_id, list_transform(l, lambda x: strlen(x.role) || ':' || x.role || strlen(x.txt) || ':' || x.txt) AS k,
                 list_transform(l, lambda x: '<|' || replace(x.role, '<|', '< |') || '|>' || chr(10) || replace(x.txt, '<|', '< |') || chr(10) || '<|end|>' || chr(10)) AS r FROM t),
    w AS (SELECT conv_id, array_to_string(k, '') AS w, len(k) AS n, array_to_string(r, '') AS rendered FROM c),
    p AS (SELECT DISTINCT array_to_string(k[1:i], '') AS w FROM (SELECT k, unnest(generate_series(1, len(k) - 1)) AS i FROM c)),
    g AS (SELECT w, min(conv_id) AS conv_id, count(*) AS n_same FROM w GROUP BY w)
    SELECT g.conv_id, CAST(n AS BIGINT) AS n_turns, CAST(n_same AS BIGINT) AS n_same, rendered
    FROM g JOIN w ON w.conv_id = g.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.w = g.w)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.chat_format import format_chats

    return format_chats(load(spark, sf_dir, "conversations"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.packing import pack, pieces

    return pack(pieces(load(spark, sf_dir, "documents"), tokenizer_path()))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.toxicity import fit, score

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def covered(spans: str):
    """The sum of the lengths of spans given as start, end, start, end ..."""
    signs = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda s, x: s + x)


@query(
    "op2_bwt_repeats",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, CAST(len(h) // 2 - 200 AS BIGINT))) AS i FROM d)),
    r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
    m AS (SELECT doc_id, i FROM s JOIN r USING (g)),
    o AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m),
    p AS (SELECT doc_id, i, sum(CASE WHEN top >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
    b AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS z FROM p GROUP BY doc_id, k),
    e AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM b),
    f AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone, max(z) AS last FROM b GROUP BY doc_id),
    t AS (SELECT e.doc_id, string_agg(substr(h, CAST(2 * y + 1 AS BIGINT), CAST(2 * (a - y) AS BIGINT)), '' ORDER BY a) AS head FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
    SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
    FROM d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.bwt_merge import remove_repeats

    kept = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = (F.size("spans") / 2).cast("long")
    return kept.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_block_anchors",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
    r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
    c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM s JOIN r USING (g)),
    x AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
    k AS (SELECT x.doc_id, count(*) AS n, count(c.p) AS gone, coalesce(string_agg(v, ' ' ORDER BY x.p) FILTER (c.p IS NULL), '') AS kept
          FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.block_anchors import remove_repeats

    kept = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", covered("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op10_jaccard_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
    l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
    k AS (SELECT a, b AS r FROM l UNION SELECT k.a, l.b FROM k JOIN l ON l.a = k.r)
    SELECT d.doc_id, least(d.doc_id, coalesce(min(k.r), d.doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d LEFT JOIN k ON k.a = d.doc_id GROUP BY d.doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnflow.llm.jaccard_join import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
