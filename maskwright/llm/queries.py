"""One query for each operator of the subpackage, and the SQL that DuckDB can hold against it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.physical import spread
from .chat_format import render
from .decontaminate import contamination
from .html_extract import extract
from .license_scan import NOTICES, license_report
from .ngram_join import near_duplicates
from .packing import pack
from .pii import replace_entities
from .quality_crf import quality_scores
from .quality_rules import quality_report
from .secret_scan import ACCESS, ASSIGN, HEX, LEAST, PRIOR, secret_report, train_locally


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, dealt over all cores where its files are too few for them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Lower-cases A-Z alone, and takes the words of the shared definition.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

def _op1() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    notices = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(NOTICES))
    return f"""
WITH n AS (SELECT k, license, {_WORDS} AS w FROM (VALUES {notices}) AS v(k, license, text)),
ns AS (SELECT DISTINCT k, license, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT k, license, w, unnest(range(1, len(w) - 3)) AS i FROM n)),
nc AS (SELECT k, license, count(*) AS m FROM ns GROUP BY k, license),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
p AS (SELECT doc_id, k, i, gram, m, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) > m + 4 THEN 1 ELSE 0 END AS cut FROM ds JOIN ns USING (gram) JOIN nc USING (k)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, k ORDER BY i) AS run FROM p),
o AS (SELECT DISTINCT doc_id, license, a, b FROM (SELECT doc_id, k, run, min(i) - 1 AS a, max(i) + 4 AS b, count(DISTINCT gram) AS c FROM r GROUP BY doc_id, k, run) JOIN nc USING (k) WHERE 5 * c >= 4 * m),
x AS (SELECT doc_id, count(DISTINCT license) AS n_licenses, string_agg(license || ':' || a || ':' || b, ',' ORDER BY a, b, license) AS spans FROM o GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT doc_id, license FROM o) GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


#: The pages of these tables hold one article element each, with headings, paragraphs and few references.
_OP2 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(t, '</?(?:p|h1)>') AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

_OP3 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, place, role, text, max(place) OVER (PARTITION BY conv_id) AS n,
  string_agg(place || chr(1) || role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY place, role, text) AS h FROM t),
w AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n GROUP BY h),
k AS (SELECT conv_id, n_copies FROM w WHERE h NOT IN (SELECT h FROM p WHERE place < n))
SELECT conv_id, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS part, count(*) AS n_turns, max(n_copies) AS n_copies,
  string_agg('<|' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10), '' ORDER BY place, role, text) AS text
FROM t JOIN k USING (conv_id) GROUP BY conv_id
"""


def _op4() -> str:
    def spans(kind: str, rank: int, pattern: str, condition: str = "true") -> str:
        pattern = pattern.replace("'", "''")
        marked = f"string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
        return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(p) AS e FROM (
          SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS s FROM (
            SELECT doc_id, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM (SELECT doc_id, {marked} AS parts FROM d)))
        WHERE i % 2 = 1 AND {condition}"""

    assign = ASSIGN.replace("'", "''")
    score = "list_sum(list_transform(range(1, length(p)), lambda k: w[ascii(p[k]) * 128 + ascii(p[k+1]) + 1]))"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
b AS (({spans("assign", 0, ASSIGN, f"length(regexp_extract(p, '{assign}', 2)) >= 6")}) UNION ALL ({spans("access", 1, ACCESS)}) UNION ALL ({spans("hex", 2, HEX)})),
c AS ({spans("markov", 3, f"[A-Za-z0-9+/_=-]{{{LEAST},}}", f"regexp_matches(p, '[A-Za-z]') AND (SELECT {score} FROM (SELECT {train_locally()} AS w)) > {PRIOR}")}),
m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
a AS (SELECT doc_id, rank, s, e, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM m)),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_markov,
  string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_markov, 0) AS n_markov,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


_OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[k:k+n-1], ' ') AS key FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM b)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS key FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item FROM dw JOIN win USING (n, key)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')))) END AS grams FROM d),
m AS (SELECT doc_id, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(grams, '|'))) END AS class_id, grams FROM g),
c AS (SELECT class_id, count(*) AS n_copies, len(any_value(grams)) AS n, any_value(grams) AS grams FROM m GROUP BY class_id),
s AS (SELECT class_id, n, unnest(grams) AS gram FROM c),
p AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 5 * i >= 4 * (na + nb - i)),
r(x, y) AS (SELECT class_id, class_id FROM c UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x AS class_id, min(y) AS group_id FROM r GROUP BY x),
t AS (SELECT x AS class_id, sum(n_copies) AS n_links, min(y) AS link_id FROM l JOIN c ON l.y = c.class_id GROUP BY x)
SELECT doc_id, class_id, n_copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, link_id, group_id FROM m JOIN c USING (class_id) JOIN k USING (class_id) LEFT JOIN t USING (class_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_secret_scan": op4_secret_scan,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_quality_classifier": op10_quality_classifier,
}

SQL: dict[str, str] = {
    "op1_license_scan": _op1(),
    "op2_html_extraction": _OP2,
    "op3_chat_formatting": _OP3,
    "op4_secret_scan": _op4(),
    "op5_benchmark_decontamination": _OP5,
    "op7_ngram_jaccard_join": _OP7,
}
