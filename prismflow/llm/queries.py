"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm.divergence import source_divergence
from prismflow.llm.exact_dedup import exact_dedup
from prismflow.llm.hard_negatives import hard_negatives
from prismflow.llm.language_id import identify_corpus
from prismflow.llm.line_dedup import LOWER, UPPER, line_dedup, with_line_digest
from prismflow.llm.mixing import mix_sources
from prismflow.llm.near_dedup import near_groups
from prismflow.llm.packing import pack_documents, with_crc
from prismflow.llm.secret_scan import BASE_RULES, MORE_RULES, secret_scan
from prismflow.llm.substring_dedup import substring_dedup, with_digest
from prismflow.llm.token_counts import corpus_token_counts
from prismflow.llm.token_store import store_and_read
from prismflow.llm.tokens import tokenizer_path
from prismflow.llm.topk import exact_top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(substring_dedup(_table(spark, sf_dir, "documents")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_corpus(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), "byte_bpe_50k")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_line_digest(line_dedup(_table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: The white-space and word rules as DuckDB regular expressions.
_WS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = UPPER, LOWER


def _matches(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """SQL for the spans of one rule: matches and the gaps before them, with running sums of their lengths."""
    p = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {place} AS place, '{kind}' AS kind, stop - n AS start, stop, t FROM (
            SELECT doc_id, n, t, sum(g + n) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
                SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, len(unnest(m)) AS n, len(unnest(q)) AS t, len(unnest(gaps[1:len(m)])) AS g FROM (
                    SELECT doc_id, regexp_extract_all(x, '{p}') AS m, regexp_extract_all(x, '{p}', {group}) AS q, regexp_split_to_array(x, '{p}') AS gaps
                    FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)) WHERE len(m) > 0))
        WHERE t >= {least}"""


_SPANS = " UNION ALL ".join(_matches(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(BASE_RULES + MORE_RULES))

_ORACLES = {
    "op1_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS x FROM documents)
        SELECT DISTINCT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    "op2_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM dup),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_exact_top_k": """
        WITH x AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM x q JOIN x c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op9_secret_scan": f"""
        WITH f AS ({_SPANS}),
        named AS (SELECT doc_id, place, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM f),
        g AS (SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b, count(*) FILTER (place = 2) AS c,
                     string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS every FROM named GROUP BY 1)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
        FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id)""",
    "op7_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM d GROUP BY source),
        o AS (
            SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - 3 * CAST(coalesce(sum(source_size) OVER p, 0) AS BIGINT) AS l,
                   CAST(sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS BIGINT) AS w
            FROM s WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT l, w FROM o WHERE l * weight <= 3 * source_size * w ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, least(f.l * o.weight / f.w, CAST(3 * source_size AS DOUBLE)) AS target FROM o, f),
        c AS (
            SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole,
                   CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
        FROM c""",
    "op11_line_dedup": rf"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM d),
        y AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM x),
        c AS (SELECT key, min(doc_id) AS first FROM y WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        z AS (SELECT y.*, coalesce(doc_id <> first, false) AS gone FROM y LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM z GROUP BY doc_id""",
    "op12_source_divergence": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        o AS (SELECT lang, source, doc_id, unnest(w) AS term FROM d),
        v AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
        c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        sizes AS (SELECT lang, count(*) AS v FROM v GROUP BY 1),
        n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 1)) // (n + sizes.v) AS p
            FROM n JOIN v USING (lang) JOIN sizes USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (
            SELECT lang, term, 1 + (1000000000 * (t + 1)) // (m + sizes.v) AS q
            FROM (SELECT lang, term, sum(c) AS t FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS m FROM n GROUP BY 1) USING (lang) JOIN sizes USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op13_hard_negatives": """
        WITH x AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(e AS DOUBLE)) FOR e IN embedding] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
