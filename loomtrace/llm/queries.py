"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_trees, decontaminate, exact_dedup, language_id, line_crf, minhash_dedup, packing, path_ratios, suffix_dedup, warc_derivatives
from .common import table

#: Vocabulary used to count tokens; any byte-level rank file serves.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks_path=RANKS)


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op3_html_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_ratios.main_text(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derivatives(table(spark, sf_dir, "pages"))


def op7_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trees.conversations_of(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


WORD = "[^\\x{00}-\\x{2f}\\x{3a}-\\x{60}\\x{7b}-\\x{7f}]+"

#: The derivative builder's expressions as DuckDB writes them; the entities are those that occur in the tables' pages.
_URN = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"


def _urn(parts: str) -> str:
    return "(SELECT " + _URN + f" FROM (SELECT md5({parts}) AS h))"


def _warc_sql() -> str:
    w = warc_derivatives
    re_ = lambda x: x.replace("'", "''")
    text = f"regexp_replace(regexp_replace(translate(regexp_replace(payload, '{re_(w.HIDDEN)}', '', 'g'), chr(13) || chr(10), '  '), '{re_(w.BLOCK)}', chr(10), 'g'), '{re_(w.TAG)}', '', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    text = f"regexp_replace(translate({text}, chr(9) || chr(11) || chr(12) || chr(13) || chr(160), '     '), ' {{2,}}', ' ', 'g')"
    text = f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    return f"""
        WITH p AS (SELECT page_id, coalesce(translate(url, chr(13) || chr(10), '  '), 'urn:page:' || page_id) AS target_uri, coalesce(html, '') AS payload FROM pages WHERE page_id IS NOT NULL),
        q AS (SELECT *, 'sha256:' || sha256(payload) AS source_digest, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) AS source_headers FROM p),
        r AS (SELECT *, {_urn("'response' || chr(10) || page_id || chr(10) || target_uri || chr(10) || source_digest")} AS refers_to FROM q),
        s AS (SELECT *, {_urn("'metadata' || chr(10) || refers_to")} AS m_id, {_urn("'conversion' || chr(10) || refers_to")} AS c_id, {text} AS c_block,
            'title: ' || trim(regexp_replace(regexp_extract(payload, '{re_(w.TITLE)}', 1), '\\s+', ' ', 'g')) || {crlf} || 'language: ' || regexp_extract(payload, '{re_(w.LANG)}', 1)
            || {crlf} || 'source-payload-digest: ' || source_digest || {crlf} || 'source-header: ' || replace(source_headers, {crlf}, {crlf} || 'source-header: ')
            || coalesce((SELECT string_agg({crlf} || 'outlink: ' || u, '' ORDER BY i) FROM (SELECT u, min(i) AS i FROM (SELECT unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT regexp_extract_all(payload, '{re_(w.HREF)}', 1) AS l)) GROUP BY u)), '') || {crlf} AS m_block FROM r),
        t AS (SELECT *, unnest(['metadata', 'conversion']) AS record_type FROM s),
        u AS (SELECT *, CASE record_type WHEN 'metadata' THEN m_block ELSE c_block END AS block FROM t)
        SELECT page_id, record_type, CASE record_type WHEN 'metadata' THEN m_id ELSE c_id END AS record_id, refers_to, CASE record_type WHEN 'metadata' THEN c_id ELSE m_id END AS concurrent_to,
            target_uri, '1970-01-01T00:00:00Z' AS date, CASE record_type WHEN 'metadata' THEN 'application/warc-fields' ELSE 'text/plain; charset=utf-8' END AS content_type,
            CAST(strlen(block) AS INTEGER) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, source_headers, block FROM u"""


ORACLES = {
    "op4_suffix_array_dedup": f"""
        WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50),
        h AS (SELECT DISTINCT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM p),
        r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
        e AS (SELECT *, CASE WHEN p - 1 <= lag(p + 49) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, p FROM r)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM e)
        SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start, CAST(max(p) + 49 AS INTEGER) AS "end", CAST(max(p) - min(p) + 50 AS INTEGER) AS words FROM s GROUP BY doc_id, span""",
    "op6_warc_derivatives": _warc_sql(),
    "op7_chat_trees": """
        WITH RECURSIVE m AS (
            SELECT conv_id, turn, arg_min(role, (role, text)) AS role, arg_min(text, (role, text)) AS text
            FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY ALL),
        n AS (SELECT a.*, (SELECT max(b.turn) FROM m b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role <> a.role) AS parent FROM m a),
        walk AS (
            SELECT conv_id, turn AS leaf, turn AS node, parent, 0 AS up FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.conv_id = a.conv_id AND b.parent = a.turn)
            UNION ALL SELECT w.conv_id, w.leaf, n.turn, n.parent, w.up + 1 FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.parent),
        p AS (
            SELECT w.conv_id, w.leaf, CAST(count(*) AS INTEGER) AS n_messages, CAST(sum(length(n.text)) AS DOUBLE) AS score,
                string_agg('<|' || replace(n.role, '<|', '< |') || '|>' || chr(10) || replace(n.text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY w.up DESC) AS text
            FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.node GROUP BY ALL)
        SELECT conv_id, leaf, CAST(rank AS INTEGER) AS rank, n_messages, score, text
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, n_messages DESC, leaf) AS rank FROM p) WHERE rank <= 2""",
    "op9_decontaminate": f"""
        WITH w AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        i AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        isz AS (SELECT item_id, text, w, least(5, len(w)) AS n, len(w) - least(5, len(w)) + 1 AS size FROM i WHERE len(w) > 0),
        ish AS (SELECT DISTINCT item_id, text, n, size, array_to_string(w[p : p + n - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, size + 1)) AS p FROM isz)),
        iset AS (SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n_shingles FROM ish),
        ineed AS (SELECT *, CAST(ceil(0.7 * n_shingles - 1e-9) AS INTEGER) AS needed FROM iset),
        dsh AS (SELECT doc_id, text AS t, n, p, array_to_string(w[p : p + n - 1], ' ') AS sh FROM
                (SELECT doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM isz))),
        hit AS (SELECT d.doc_id, d.t, i.item_id, i.text, i.size, i.needed, i.n_shingles, d.p, d.sh FROM dsh d JOIN ineed i ON d.n = i.n AND d.sh = i.sh),
        win AS (SELECT a.doc_id, a.item_id, a.needed, a.n_shingles, a.text, a.t, a.p, count(DISTINCT b.sh) AS overlap
                FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.t = b.t AND a.item_id = b.item_id AND a.text = b.text AND b.p BETWEEN a.p AND a.p + a.size - 1
                GROUP BY ALL),
        best AS (SELECT doc_id, item_id, max({{'overlap': overlap, 'n_shingles': n_shingles, 'needed': needed}}) AS m FROM win WHERE overlap >= needed GROUP BY ALL)
        SELECT doc_id, item_id, m.overlap AS overlap, m.needed AS needed, m.n_shingles AS n_shingles FROM best""",
    "op2_exact_dedup": """
        SELECT DISTINCT doc_id, keep_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        WHERE doc_id <> keep_id""",
}
