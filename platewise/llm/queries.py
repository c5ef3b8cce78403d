"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import chat_format, decontaminate, filter_audit, language_id, license_scan, near_dedup, packing, pii, quality, sharding, simhash, token_counts, whitening
from platewise.llm.common import table

#: Fixed text of the conversation that the query of chat formatting adds: control strings.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :text), (-7L, 1L, 'assistant', :text) AS t(conv_id, turn, role, text)", args={"text": EXTRA_TEXT})
    return chat_format.chat_digests(chat_format.format_chats(turns.unionByName(extra)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup_table(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(table(spark, sf_dir, "documents")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_table(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_quality_rules,
        op3_language_id,
        op4_license_scan,
        op5_sharding,
        op6_near_dedup,
        op7_decontaminate,
        op8_token_counts,
        op9_packing,
        op10_pii,
        op11_simhash,
        op12_whitening,
        op13_filter_audit,
    )
}

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '#', '\h'), '<', '\l')"
ORACLE_SQL = {
    "op1_chat_format": rf"""
        WITH given AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        parts AS (
          SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
                 replace({_ESCAPED.format('role')}, chr(10), '\n') AS esc_role, {_ESCAPED.format('text')} AS esc_text
          FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(esc_text) + CASE WHEN opens THEN length(esc_role) + 13 ELSE 5 END)::BIGINT AS formatted_chars
        FROM parts GROUP BY conv_id""",
    "op6_near_dedup": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' ')))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
        classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets GROUP BY 1),
        members AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
        common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS an, any_value(b.n) AS bn
                   FROM members a JOIN members b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
        links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (an + bn - c)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT rep AS a, rep AS b FROM classes WHERE len(s) > 0 UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY 1)
        SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
               coalesce(r.root, d.doc_id) = d.doc_id AS kept
        FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s AND len(d.s) > 0 LEFT JOIN roots r ON r.rep = c.rep""",
    "op13_filter_audit": r"""
        WITH plain AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        words AS (SELECT *, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM plain),
        fails AS (
          SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM words),
        flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
        marked AS (
          SELECT part, [a, b, c, d, e] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
          FROM fails LEFT JOIN flags USING (doc_id)),
        cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY 1, 2),
        letters AS (SELECT unnest(range(1, 6)) AS k),
        orders AS (
          SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
          WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
        met AS (
          SELECT part, o, step, n, good, toxic, f[o[step]] AS fails, len(list_filter(o[:step - 1], lambda x: f[x])) = 0 AS reached,
                 len(list_filter(f, lambda x: x)) = 1 AND f[o[step]] AS alone, o[step] AS k
          FROM cells CROSS JOIN steps),
        counted AS (
          SELECT part, o, step, k, coalesce(sum(n) FILTER (reached AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND fails), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER (NOT reached AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER (reached AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (reached AND fails), 0)::BIGINT AS toxic_lost
          FROM met GROUP BY 1, 2, 3, 4),
        names AS (SELECT *, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order FROM counted)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM names""",
}
