"""The catalog tables as deterministic views over the driver's tables.

One SQL text serves Spark and the oracle engine; {name} stands for a driver table.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "catalog": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'http://catalog.example/' || n_name AS url,
               'All ' || n_name AS descr, CASE n_nationkey % 3 WHEN 0 THEN 'biography' WHEN 1 THEN 'art' ELSE 'unknown' END AS type,
               CAST(CASE WHEN n_nationkey % 3 = 0 THEN 212 + n_regionkey END AS BIGINT) AS wd_prop,
               CAST(CASE WHEN n_nationkey % 11 = 7 THEN 1 END AS BIGINT) AS wd_qual, 'en' AS search_wp,
               CASE WHEN n_nationkey % 5 = 4 THEN 0 ELSE 1 END AS active, CAST(n_nationkey % 4 AS BIGINT) AS owner,
               CASE n_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS has_person_date
        FROM {nation}""",
    "entry": """
        SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 25 AS BIGINT) AS catalog,
               'P' || CAST(p_partkey AS VARCHAR(20)) AS ext_id,
               CASE p_partkey % 6 WHEN 0 THEN '' ELSE 'http://entry.example/' || CAST(p_partkey AS VARCHAR(20)) END AS ext_url,
               p_name AS ext_name, p_type || ' ' || p_brand AS ext_desc,
               CAST(CASE p_partkey % 7 WHEN 1 THEN p_partkey % 13 + 1 WHEN 2 THEN p_partkey % 13 + 1 WHEN 3 THEN 0
                                       WHEN 4 THEN -1 WHEN 5 THEN p_partkey % 13 + 1 END AS BIGINT) AS q,
               CAST(CASE p_partkey % 7 WHEN 1 THEN 0 WHEN 2 THEN 7 WHEN 3 THEN 7 WHEN 4 THEN 8 WHEN 5 THEN 4 END AS BIGINT) AS uid,
               CASE WHEN p_partkey % 7 IN (1, 2, 3, 4, 5) THEN '20240' || CAST(p_partkey % 9 + 1 AS VARCHAR(2)) || '15000000' END AS ts,
               CASE p_partkey % 4 WHEN 0 THEN 'Q5' WHEN 1 THEN 'Q16521' WHEN 2 THEN 'Q838948' ELSE '' END AS type
        FROM {part}""",
    "person_dates": """
        SELECT entry_id, born, died, substr(born, 1, 4) AS year_born, substr(died, 1, 4) AS year_died FROM (
        SELECT CAST(o_custkey AS BIGINT) AS entry_id,
               substr(CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR(10)), 1, CASE o_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 4 ELSE 7 END) AS born,
               CASE WHEN o_custkey % 5 = 0 THEN '' ELSE substr(CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR(10)), 1,
                    CASE o_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 4 ELSE 7 END) END AS died
        FROM {orders} GROUP BY o_custkey) d""",
    "auxiliary": """
        SELECT DISTINCT CAST(l_partkey * 1000000 + l_linenumber % 5 * 1000 + l_suppkey % 40 AS BIGINT) AS id,
               CAST(l_partkey AS BIGINT) AS entry_id,
               CAST(CASE l_linenumber % 5 WHEN 0 THEN 214 WHEN 1 THEN 227 WHEN 2 THEN 1207 WHEN 3 THEN 1273 ELSE 17 END AS BIGINT) AS aux_p,
               'A' || CAST(l_suppkey % 40 AS VARCHAR(20)) || '-' || CAST(l_partkey % 50 AS VARCHAR(20)) AS aux_name,
               CAST(l_suppkey % 2 AS INT) AS in_wikidata, CASE WHEN l_partkey % 7 IN (1, 2, 5) THEN 1 ELSE 0 END AS entry_is_matched
        FROM {lineitem}""",
    "location": """
        SELECT CAST(c_custkey AS BIGINT) AS entry_id, CAST(c_custkey * 37 % 180 - 90 AS DOUBLE) AS lat,
               CAST(c_custkey * 91 % 360 - 180 AS DOUBLE) AS lon FROM {customer}""",
    "mnm_relation": """
        SELECT DISTINCT CAST(l_partkey AS BIGINT) AS entry_id, CAST(CASE l_linenumber % 2 WHEN 0 THEN 170 ELSE 50 END AS BIGINT) AS property,
               CAST((l_partkey * 7 + l_linenumber) % 200 AS BIGINT) AS target_entry_id FROM {lineitem}""",
    "aliases": """
        SELECT CAST(doc_id AS BIGINT) AS entry_id, lang AS language, substr(text, 1, 30) AS label, CAST(doc_id % 2 AS INT) AS added_by_user
        FROM {documents} WHERE lang IS NOT NULL UNION
        SELECT CAST(p_partkey + 1 AS BIGINT), 'en', p_name, 0 FROM {part} WHERE p_partkey % 5 = 0""",
    "descriptions": """
        SELECT CAST(doc_id AS BIGINT) AS entry_id, lang AS language, substr(text, 31, 40) AS label FROM {documents} WHERE lang IS NOT NULL""",
    "kv_entry": """
        SELECT CAST(s_suppkey AS BIGINT) AS entry_id, CASE s_suppkey % 2 WHEN 0 THEN 'image' ELSE 'note' END AS kv_key, s_name AS kv_value FROM {supplier}""",
    "kv_catalog": """
        SELECT CAST(n_nationkey AS BIGINT) AS catalog_id, CASE n_nationkey % 3 WHEN 0 THEN 'has_locations' WHEN 1 THEN 'created_at' ELSE 'use_automatchers' END AS kv_key,
               CASE n_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '2024-01-' || CAST(n_nationkey + 10 AS VARCHAR(2)) ELSE '1' END AS kv_value FROM {nation}""",
    "multi_match": """
        SELECT CAST(p_partkey AS BIGINT) AS entry_id, CAST(p_partkey % 25 AS BIGINT) AS catalog,
               CAST(p_partkey % 13 + 1 AS VARCHAR(20)) || ',' || CAST(p_partkey % 13 + 2 AS VARCHAR(20)) AS candidates, 2 AS candidate_count
        FROM {part} WHERE p_partkey % 6 = 0""",
    "statement_text": """
        SELECT CAST(event_id AS BIGINT) AS id, CAST(event_id % 2000 + 1 AS BIGINT) AS entry_id, CAST(100 + event_id % 3 AS BIGINT) AS property,
               event_type || ' ' || CAST(user_id % 7 AS VARCHAR(20)) AS text, CAST(event_id % 2 AS INT) AS in_wikidata,
               CAST(event_id % 3 AS INT) AS entry_is_matched, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 13 + 1 END AS BIGINT) AS q FROM {events}""",
    "issues": """
        SELECT CAST(doc_id AS BIGINT) AS id, CAST(doc_id + 1 AS BIGINT) AS entry_id,
               CASE doc_id % 3 WHEN 0 THEN 'WD_DUPLICATE' WHEN 1 THEN 'MISMATCH_DATES' ELSE 'MISMATCH' END AS type,
               CASE doc_id % 3 WHEN 0 THEN '["Q' || CAST(doc_id % 13 + 1 AS VARCHAR(20)) || '","Q' || CAST(doc_id % 11 + 1 AS VARCHAR(20)) || '"]'
                    ELSE '{{"mnm_time":"+19' || CAST(10 + doc_id % 80 AS VARCHAR(2)) || CASE doc_id % 2 WHEN 0 THEN '-01-01' ELSE '-05-06' END || '"}}' END AS json,
               CASE doc_id % 4 WHEN 3 THEN 'DONE' ELSE 'OPEN' END AS status, CAST((doc_id + 1) % 25 AS BIGINT) AS catalog FROM {documents}""",
    "log": """
        SELECT CAST(event_id AS BIGINT) AS id, CASE event_type WHEN 'click' THEN 'remove_q' ELSE event_type END AS action,
               CAST(event_id % 2000 + 1 AS BIGINT) AS entry_id, CAST(user_id AS BIGINT) AS uid,
               replace(replace(replace(substr(CAST(ts AS VARCHAR(40)), 1, 19), '-', ''), ':', ''), ' ', '') AS ts,
               CAST(CASE event_id % 3 WHEN 0 THEN NULL ELSE event_id % 13 + 1 END AS BIGINT) AS q FROM {events}""",
    "wd_matches": """
        SELECT CAST(o_orderkey AS BIGINT) AS entry_id, CASE o_orderkey % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'SAME' WHEN 2 THEN 'WD_MISSING' WHEN 3 THEN 'DIFFERENT' ELSE 'MULTIPLE' END AS status,
               '20240101000000' AS ts, CAST(CASE o_orderkey % 9 WHEN 0 THEN 0 ELSE o_orderkey % 25 END AS BIGINT) AS catalog FROM {orders}""",
    "jobs": """
        SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_custkey % 4 WHEN 0 THEN 'automatch' WHEN 1 THEN 'microsync' WHEN 2 THEN 'aux2wd' ELSE 'taxon_matcher' END AS action,
               CAST(o_custkey % 25 AS BIGINT) AS catalog, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey - 1 END AS BIGINT) AS depends_on,
               CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'TODO' ELSE 'FAILED' END AS status,
               replace(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), '-', '') || '000000' AS last_ts,
               CASE o_orderkey % 2 WHEN 0 THEN '' ELSE replace(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10), '-', '') || '000000' END AS next_ts,
               CASE o_custkey % 3 WHEN 0 THEN 'at ' || CAST(o_custkey AS VARCHAR(20)) END AS json, CASE o_custkey % 5 WHEN 0 THEN 'failed' END AS note,
               CAST(o_custkey % 10 AS BIGINT) AS uid, CAST(CASE o_orderkey % 8 WHEN 0 THEN 3600 END AS BIGINT) AS repeat_after_sec FROM {orders}""",
    "job_sizes": """
        SELECT CASE r_regionkey WHEN 0 THEN 'automatch' WHEN 1 THEN 'microsync' WHEN 2 THEN 'aux2wd' WHEN 3 THEN 'feed_sync' ELSE 'update_issues' END AS action,
               CASE r_regionkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'MEDIUM' ELSE 'LARGE' END AS size,
               CAST(CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 100 + 60 END AS BIGINT) AS max_seconds FROM {region}""",
    "entry_creation": "SELECT CAST(p_partkey AS BIGINT) AS entry_id, '20230' || CAST(p_partkey % 9 + 1 AS VARCHAR(2)) || '01000000' AS ts FROM {part} WHERE p_partkey % 2 = 0",
    "kv": "SELECT 'feed_' || lower(r_name) AS kv_key, '2024010' || CAST(r_regionkey + 1 AS VARCHAR(2)) || '000000' AS kv_value FROM {region}",
    "props_todo": """
        SELECT CAST(200 + n_nationkey AS BIGINT) AS property_num, n_name AS property_name, '' AS default_type,
               CASE n_nationkey % 3 WHEN 0 THEN 'NO_CATALOG' WHEN 1 THEN 'DONE' ELSE 'BAD' END AS status, '' AS note, CAST(0 AS BIGINT) AS uid,
               CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS BIGINT) AS items_using FROM {nation}""",
    "property_cache": """
        SELECT CAST(CASE n_nationkey % 2 WHEN 0 THEN 31 ELSE 17 END AS BIGINT) AS prop_group, CAST(212 + n_regionkey AS BIGINT) AS property,
               CAST(n_nationkey + 500 AS BIGINT) AS item, lower(n_name) AS label FROM {nation}""",
    "top_groups": """
        SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR(9)) || ',1' END AS catalogs,
               CAST(s_suppkey % 10 AS BIGINT) AS uid, '20240101000000' AS ts, CASE s_suppkey % 3 WHEN 0 THEN 0 ELSE 1 END AS is_current, CAST(0 AS BIGINT) AS based_on FROM {supplier}""",
    "scripts": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 4 WHEN 0 THEN 'PERSON_DATE' WHEN 1 THEN 'AUX_FROM_DESC' WHEN 2 THEN 'DESC_FROM_HTML' ELSE 'COORDS_FROM_HTML' END AS kind,
               CAST(floor(n_nationkey / 2) AS BIGINT) AS catalog, CASE n_nationkey % 7 WHEN 0 THEN '' ELSE 'code of ' || lower(n_name) END AS code, CASE n_nationkey % 5 WHEN 0 THEN 0 ELSE 1 END AS is_active,
               '' AS note, '20240101000000' AS last_run FROM {nation}""",
    "scrapers": "SELECT CAST(n_nationkey AS BIGINT) AS catalog, 'spec of ' || n_name AS json, CASE n_nationkey % 4 WHEN 0 THEN 'RUNNING' ELSE 'OK' END AS status, CAST(n_regionkey AS BIGINT) AS owner, '' AS last_update FROM {nation}",
    "update_info": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 10 AS BIGINT) AS catalog, 'v' || CAST(n_nationkey AS VARCHAR(9)) AS json, '' AS note, CAST(n_regionkey AS BIGINT) AS uid,
               CASE WHEN n_nationkey >= 15 THEN 1 ELSE 0 END AS is_current FROM {nation}""",
    "import_file": """
        SELECT 'u-' || CAST(s_suppkey AS VARCHAR(20)) AS uuid, CAST(s_suppkey % 10 AS BIGINT) AS uid, '20240101000000' AS ts,
               CASE s_suppkey % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'TSV' ELSE 'SSV' END AS type FROM {supplier}""",
    "feed_sources": "SELECT CAST(n_nationkey * 3 AS BIGINT) AS scraper_id, CAST(n_nationkey AS BIGINT) AS catalog_id, '20240101' AS last_sync FROM {nation}",
    "given_names": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_nationkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS gender FROM {nation}",
    "entry_names": "SELECT CAST(p_partkey AS BIGINT) AS entry_id, CAST(p_partkey % 25 AS BIGINT) AS given_name_id, CAST(p_partkey * 7919 % 10007 AS DOUBLE) / 10007 AS random FROM {part} WHERE p_partkey % 2 = 0",
    "large_report": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(l_partkey % 5 AS BIGINT) AS catalog_id, CAST(200 + l_suppkey % 7 AS BIGINT) AS prop,
               CASE l_returnflag WHEN 'A' THEN 'DONE' WHEN 'R' THEN 'OPEN' ELSE 'WAIT' END AS status, CASE l_linestatus WHEN 'F' THEN 'MISMATCH' ELSE 'MISSING' END AS type,
               CASE l_linenumber % 3 WHEN 0 THEN '' ELSE 'User ' || CAST(l_suppkey % 10 AS VARCHAR(9)) END AS user_name,
               replace(substr(CAST(l_shipdate AS VARCHAR(40)), 1, 10), '-', '') || '000000' AS ts FROM {lineitem}""",
    "reference_queue": "SELECT CAST(n_nationkey AS BIGINT) AS q, CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE 0 END AS done FROM {nation}",
    "users": """
        SELECT DISTINCT CAST(user_id AS BIGINT) AS id, 'User ' || CAST(user_id AS VARCHAR(20)) AS name, CASE user_id % 10 WHEN 0 THEN 1 ELSE 0 END AS is_catalog_admin FROM {events}""",
    "kb_terms": "SELECT DISTINCT p_name AS text, CAST(p_partkey % 3 + length(p_name) AS BIGINT) AS q, 'en' AS language FROM {part} WHERE p_partkey % 2 = 0 UNION SELECT lower(n_name) || ' ID', CAST(n_nationkey AS BIGINT), 'en' FROM {nation}",
    "kb_sitelinks": "SELECT 'enwiki' AS site, p_name AS title, CAST(min(p_partkey) % 7 + 1 AS BIGINT) AS q FROM {part} GROUP BY p_name",
    "kb_redirects": "SELECT CAST(n_nationkey AS BIGINT) AS from_q, CAST(n_nationkey + 100 AS BIGINT) AS to_q FROM {nation} WHERE n_nationkey % 4 = 3",
    "kb_items": "SELECT CAST(n_nationkey AS BIGINT) AS q FROM {nation} WHERE n_nationkey NOT IN (9, 10)",
    "kb_claims": """
        SELECT DISTINCT CAST(CASE WHEN l_linenumber % 5 <> 4 AND l_suppkey % 40 < 30 THEN l_partkey % 50 % 13 + 1 ELSE l_partkey % 13 + 1 END AS BIGINT) AS q,
               CAST(CASE l_linenumber % 5 WHEN 0 THEN 214 WHEN 1 THEN 227 WHEN 2 THEN 1207 WHEN 3 THEN 1273 ELSE 212 + l_partkey % 5 END AS BIGINT) AS property,
               CASE l_linenumber % 5 WHEN 4 THEN 'P' || CAST(l_partkey AS VARCHAR(20)) ELSE 'A' || CAST(l_suppkey % 40 AS VARCHAR(20)) || '-' || CAST(l_partkey % 50 AS VARCHAR(20)) END AS value
        FROM {lineitem} WHERE l_partkey % 3 = 0 UNION
        SELECT CAST(n_nationkey AS BIGINT), 31, CASE WHEN n_nationkey % 4 = 1 THEN 'Q4167410' ELSE 'Q5' END FROM {nation}""",
}

DRIVER = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The views as DataFrames, built when asked for, and the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            used = {n: self.driver(n) for n in DRIVER if f"{{{n}}}" in VIEWS[name]}
            self._made[name] = self.spark.sql(VIEWS[name], **used)
        return self._made[name]


def prelude(sql: str) -> str:
    """The same views, those that an oracle's text names, as its WITH clause."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    texts = [f"{v} AS ({VIEWS[v].format(**{n: n for n in DRIVER})})" for v in used]
    if not used:
        return sql
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    return f"WITH {own and own[1] or ''}{', '.join(texts)}" + (f", {sql[own.end():]}" if own else f" {sql}")
