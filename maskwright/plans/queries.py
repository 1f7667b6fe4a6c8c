"""Named queries over the driver's tables, each with SQL that DuckDB can run where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import columns as O
from ..operators import relations as R
from ..operators.matching import Rule
from ..operators.physical import spread
from ..operators.select import choose_column, splice_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rules of the example queries.
RULES = (Rule("token", "credential", fuzzy_threshold=0.0), Rule("MIT License", "Demo License", fuzzy_threshold=0.9), Rule("no such phrase anywhere", "x", fuzzy_threshold=0.0))


@query()
def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: whole documents anonymized under rules, with counts."""
    out = O.anonymize(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), RULES)
    n = F.coalesce(F.aggregate("result.automatic", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    return out.select("doc_id", F.col("result.text").alias("text"), F.array_join("result.matches", ",").alias("rule_matches"), n.alias("n_automatic"), F.size("result.suggestions").cast("long").alias("n_suggestions"))


@query()
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections of the documents as rows."""
    spans = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(O.detect_spans()("text")).alias("d"))
    return spans.select("doc_id", "d.kind", "d.value", "d.start", "d.end", "d.confidence", "d.reason", "d.automatic")


@query()
def anonymize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as units of one document, numbered through it."""
    units = spread(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), F.lit(None).cast("string").alias("markup"), "text")
    return O.anonymize_units(units).select("doc_id", "unit_no", "text")


@query()
def anonymize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML pages anonymized in their visible text and attributes, tags kept."""
    out = O.anonymize(spread(table(spark, sf_dir, "pages").select("page_id", "html")), (), text="html", markup="html")
    return out.select("page_id", F.col("result.text").alias("html"))


@query(
    r"""WITH m AS (SELECT page_id, regexp_replace(html, '<[^>]*>', chr(1), 'g') AS t FROM pages)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '^\x01+', ''), '(\s)\x01+', '\1', 'g'), '\x01+', ' ', 'g') AS visible FROM m"""
)
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", O.visible_text("html")("html").alias("visible"))


# An engine without look-arounds needs a character on either side of a value for itself, so the SQL doubles those that may stand between two.
_BETWEEN = r"([^\p{L}\p{N}_.%+@-])"
_SQL_PATTERNS = (
    ("email", r"(?:^|[^\p{L}\p{N}_.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63})(?:$|[^\p{L}\p{N}_.-])"),
    ("id_or_ruc", r"(?:^|[^\p{L}\p{N}_.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:$|\.(?:$|[^0-9])|[^\p{L}\p{N}_.])"),
    ("account", r"(?:^|[^\p{L}\p{N}_-])([0-9]{13,19})(?:$|[^\p{L}\p{N}_-])"),
)


def _doubled(text: str) -> str:
    return f"regexp_replace({text}, '{_BETWEEN}', '\\1\\1', 'g')"


def _found(table: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS doc_id, '{k}' AS kind, unnest(regexp_extract_all({_doubled(text)}, '{p}', 1)) AS value FROM {table}" for k, p in _SQL_PATTERNS)


def _native(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, ord, kind, value) of mail addresses, dotted numbers and long numbers, without Python."""

    def of(kind: str, native: str) -> Column:
        return F.transform(C.native_values(F.col(text), native), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(of("email", "email"), of("id_or_ruc", "ipv4"), of("account", "number"))
    return df.select(F.col(key).alias("doc_id"), F.posexplode(found).alias("ord", "d")).select("doc_id", "ord", "d.kind", "d.value")


@query(f"SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs FROM ({_found('documents', 'doc_id', 'text')}) GROUP BY kind")
def native_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _native(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"SELECT doc_id, kind, value FROM ({_found('pages', 'page_id', 'html')})")
def native_page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _native(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "page_id", "html").select("doc_id", "kind", "value")


@query(
    f"""WITH t AS (SELECT doc_id, {_doubled("text")} AS t FROM documents),
    r AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}_.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,63}}($|[^\\p{{L}}\\p{{N}}_.-])', '\\1[[EMAIL]]\\2', 'g'),
      '(^|[^\\p{{L}}\\p{{N}}_.])[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}($|\\.$|\\.[^0-9]|[^\\p{{L}}\\p{{N}}_.])', '\\1[[IPV4]]\\2', 'g') AS t FROM t)
    SELECT doc_id, sha256(regexp_replace(t, '([^\\p{{L}}\\p{{N}}_.%+@-])([^\\p{{L}}\\p{{N}}_.%+@-])', '\\1', 'g')) AS redacted_sha256 FROM r"""
)
def native_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.sha2(C.native_redact(F.col("text"), ("email", "ipv4")), 256).alias("redacted_sha256"))


@query(
    r"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct, sha256(replace(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')), 'ß', 'ss')) AS squeezed_sha256
    FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents)"""
)
def tokens_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", C.words(F.col("text")).alias("w"))
    return df.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform("w", F.lower))).cast("long").alias("n_distinct"), F.sha2(C.squeeze(F.col("text")), 256).alias("squeezed_sha256"))


@query(
    r"""SELECT p_partkey, p_type, CASE WHEN NOT regexp_matches(p_type, '\p{L}') THEN 'none' WHEN upper(p_type) = p_type THEN 'upper' WHEN lower(p_type) = p_type THEN 'lower'
    WHEN len(list_filter(regexp_extract_all(p_type, '[\p{L}\p{N}]+'), lambda w: length(w) > 1 AND regexp_matches(w, '\p{L}') AND NOT regexp_matches(w, '^\p{Lu}[\p{Ll}\p{N}]*\p{Ll}[\p{Ll}\p{N}]*$'))) = 0 THEN 'title' ELSE 'mixed' END AS case_class FROM part"""
)
def case_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", C.case_class(F.col("p_type")).alias("case_class"))


@query(
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'DEMO SECTOR' WHEN c_mktsegment = 'MACHINERY' THEN 'OTHER SECTOR' ELSE c_mktsegment END AS segment,
    CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS n_building, CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS n_machinery FROM customer"""
)
def rule_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smart rules with case transfer on a column; only distinct values are matched."""
    rules = (Rule("building", "Demo Sector", fuzzy_threshold=0.0), Rule("machinery", "Other Sector", fuzzy_threshold=0.0))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    done = O.anonymize(base.select("c_mktsegment").distinct(), rules, text="c_mktsegment", rescan=False)
    done = done.select("c_mktsegment", F.col("result.text").alias("segment"), F.col("result.matches")[0].alias("n_building"), F.col("result.matches")[1].alias("n_machinery"))
    return base.join(done, "c_mktsegment").drop("c_mktsegment")


_RULE_ROWS = [(0, "BUILDING"), (1, "MACHINERY"), (2, "NOTHING LIKE IT")]


@query(
    """SELECT r.rule_idx, count(c.c_custkey) AS matches, CAST(0 AS BIGINT) AS absorbed, count(c.c_custkey) AS effective
    FROM (VALUES (0, 'BUILDING'), (1, 'MACHINERY'), (2, 'NOTHING LIKE IT')) AS r(rule_idx, source) LEFT JOIN customer c ON c.c_mktsegment = r.source GROUP BY r.rule_idx"""
)
def rule_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULE_ROWS, "rule_idx int, source string")
    edits = table(spark, sf_dir, "customer").join(F.broadcast(rules), F.col("c_mktsegment") == F.col("source")).select(F.col("rule_idx").alias("index"), F.lit(True).alias("selected"))
    return R.rule_counts(rules.drop("source"), edits)


@query(
    """WITH e AS (SELECT * FROM (VALUES (0, 6, 75, 'person', 'A'), (4, 12, 85, 'organization', 'BB'), (14, 20, 60, 'value', 'C'), (15, 18, 120, 'email', 'D')) AS e(s, t, p, kind, r)),
    o AS (SELECT o_orderkey, 'aaaabbbbccccddddeeeeffff' || o_orderpriority AS text FROM orders)
    SELECT o_orderkey, substr(text, 1, 4) || 'BB' || substr(text, 13, 3) || 'D' || substr(text, 19) AS text, 2 AS n_edits FROM o"""
)
def select_and_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice among overlapping edits and their application, in the JVM."""
    edits = [(0, 6, "A", "person", 75), (4, 12, "BB", "organization", 85), (14, 20, "C", "value", 60), (15, 18, "D", "email", 120)]
    fields = ("start", "end", "replacement", "kind", "priority")
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(fields, e, strict=True)), F.lit(-1).alias("index")) for e in edits))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("aaaabbbbccccddddeeeeffff"), "o_orderpriority").alias("text"), made.alias("edits"))
    df = df.withColumn("chosen", choose_column("edits"))
    return df.select("o_orderkey", splice_column("text", "chosen").alias("text"), F.size("chosen").alias("n_edits"))


@query(
    """WITH v AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN role = 'user' THEN 'person' ELSE 'organization' END AS kind, regexp_extract(text, '^[^ .,]+') AS value FROM conversations),
    k AS (SELECT *, lower(regexp_replace(trim(value), '[^\\p{L}\\p{N}_]+', '', 'g')) AS key FROM v),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) AS rn, first_value(kind) OVER (PARTITION BY doc_id, key ORDER BY ord) AS owner FROM k),
    n AS (SELECT doc_id, key, owner, row_number() OVER (PARTITION BY doc_id, owner ORDER BY ord) AS n FROM f WHERE rn = 1)
    SELECT f.doc_id, f.ord, f.value, CASE WHEN n.owner = 'person' THEN 'PERSON-' ELSE 'COMPANY-' END || lpad(CAST(n.n AS VARCHAR), 4, '0') AS placeholder FROM f JOIN n USING (doc_id, key)"""
)
def placeholders_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "person").otherwise("organization").alias("kind"), F.regexp_extract("text", "^[^ .,]+", 0).alias("value"))
    return R.document_placeholders(values).drop("kind")


@query("""SELECT c_custkey, 'COMPANY-' || substr(sha256('k|' || lower(regexp_replace(trim(c_name), '[^A-Za-z0-9_]+', '', 'g'))), 1, 16) AS placeholder FROM customer""")
def placeholders_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select("c_custkey", F.lit("organization").alias("kind"), F.col("c_name").alias("value"))
    return R.corpus_placeholders(values, "k").select("c_custkey", "placeholder")


def _supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(i).alias("row_idx"), F.lit(j).alias("col_idx"), v.alias("value")) for i, row in enumerate(((F.lit("Name:"), F.col("s_name")), (F.lit("Nation"), F.col("s_nationkey").cast("string")), (F.lit("phone"), F.lit("6000-0000")))) for j, v in enumerate(row)))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.inline(cells))


@query(
    """WITH c AS (SELECT s_suppkey AS doc_id, unnest([0, 0, 1, 1, 2, 2]) AS row_idx, unnest([0, 1, 0, 1, 0, 1]) AS col_idx, unnest(['Name:', s_name, 'Nation', CAST(s_nationkey AS VARCHAR), 'phone', '6000-0000']) AS value FROM supplier),
    k AS (SELECT *, CASE lower(rtrim(trim(value), ':')) WHEN 'name' THEN 'person' WHEN 'phone' THEN 'phone' END AS kind FROM c),
    w AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id, row_idx ORDER BY col_idx) AS l, max(CASE WHEN row_idx = 0 THEN kind END) OVER (PARTITION BY doc_id, col_idx) AS h FROM k)
    SELECT doc_id, row_idx, col_idx, value, CASE WHEN kind IS NULL THEN coalesce(l, CASE WHEN row_idx > 0 THEN h END) END AS context FROM w"""
)
def table_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_contexts(_supplier_cells(spark, sf_dir))


@query(
    """SELECT n_regionkey AS doc_id, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) ||
    string_agg('| ' || replace(n_name, '|', '\\|') || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey"""
)
def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown table per region."""
    n = table(spark, sf_dir, "nation")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    cell = lambda row, col, v: F.struct(row.alias("row_idx"), F.lit(col).alias("col_idx"), v.alias("value"))
    body = n.withColumn("i", place).select(F.col("n_regionkey").alias("doc_id"), F.inline(F.array(cell(F.col("i"), 0, F.col("n_name")), cell(F.col("i"), 1, F.col("n_nationkey").cast("string")))))
    head = n.select(F.col("n_regionkey").alias("doc_id")).distinct().select("doc_id", F.inline(F.array(cell(F.lit(0), 0, F.lit("nation")), cell(F.lit(0), 1, F.lit("key")))))
    return R.markdown_tables(head.unionByName(body))


@query(
    """WITH c AS (SELECT o_orderkey % 50 AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey, o_orderstatus FROM orders),
    v AS (SELECT doc_id, row_idx, CASE WHEN row_idx < 3 THEN o_orderstatus ELSE '' END AS value FROM c) SELECT doc_id, row_idx, 0 AS col_idx, value FROM v WHERE row_idx < 3"""
)
def trimmed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = (F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) - 1).alias("row_idx")
    cells = table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_orderkey") % 50).select("doc_id", row, "o_orderstatus")
    cells = cells.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select("doc_id", "row_idx", F.col("c").alias("col_idx"), F.when((F.col("row_idx") < 3) & (F.col("c") == 0), F.col("o_orderstatus")).otherwise("").alias("value"))
    return R.trim_edges(cells).withColumn("row_idx", F.col("row_idx").cast("long"))


@query(
    f"""WITH f AS (SELECT doc_id, kind, value, CASE kind WHEN 'email' THEN 0 WHEN 'id_or_ruc' THEN 1 ELSE 2 END AS k FROM ({_found('documents', 'doc_id', 'text')})),
    u AS (SELECT DISTINCT doc_id, kind, lower(CASE WHEN kind = 'email' THEN value ELSE regexp_replace(value, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') END) AS key FROM f)
    SELECT doc_id, kind, count(*) AS n_suggestions FROM u GROUP BY doc_id, kind"""
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct findings per document, at most 80."""
    found = R.top_suggestions(_native(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text"))
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_suggestions"))


@query(
    f"""SELECT kind, count(*) AS matches, CASE kind WHEN 'email' THEN 'EMAIL-0001@example.com' WHEN 'id_or_ruc' THEN 'ID-0001' ELSE 'ACCOUNT-0001' END AS replacement, 'replaced' AS status
    FROM ({_found('documents', 'doc_id', 'text')}) GROUP BY kind"""
)
def automatic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.automatic_report(_native(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text"))


@query(
    f"""WITH f AS (SELECT doc_id, count(*) AS n FROM ({_found('documents', 'doc_id', 'text')}) GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(n, 0) AS n, len(regexp_extract_all(text, 'License')) AS m FROM documents LEFT JOIN f USING (doc_id))
    SELECT doc_id, CASE WHEN n + m = 0 OR m = 0 THEN 'refused' ELSE 'passed' END AS status,
    concat_ws('; ', CASE WHEN n + m = 0 THEN 'zero replacements/redactions matched' END, CASE WHEN m = 0 THEN 'rules with zero matches: rule-001' END) AS problems FROM d"""
)
def safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = _native(docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_automatic"))
    rows = docs.select("doc_id", F.array(F.regexp_count("text", F.lit("License")).cast("long")).alias("matches"), F.array(F.lit(0).cast("long")).alias("absorbed"), F.lit(0).alias("n_suggestions"))
    rows = rows.join(n, "doc_id", "left").na.fill(0, ["n_automatic"])
    return R.gate(rows, require_all_rules=True).select("doc_id", "status", F.array_join("problems", "; ").alias("problems"))


@query(
    """WITH v AS (SELECT o_orderkey, unnest(['email', 'email', 'person', 'value', 'phone']) AS kind, unnest(['x' || o_orderkey || '@mail.example.com', 'y@' || o_orderstatus || '.test', 'PERSON-0001', ' Demo Company ', 'tel-' || o_orderkey]) AS value FROM orders)
    SELECT o_orderkey, kind, value, regexp_matches(trim(value), '(?i)^(?:PERSON|COMPANY|EMAIL|PHONE|ID|ADDRESS|ACCOUNT|DATE|LOCATION|VALUE)-[0-9]+(?:@(?:example\\.(?:com|org|net)|demo\\.local|local))?$')
      OR (kind = 'email' AND regexp_matches(lower(trim(value)), '@[^@]*(?:\\.local|example\\.com|example\\.org|example\\.net)$'))
      OR lower(trim(value)) IN ('tel-0000', 'id-0000', 'persona demo', 'empresa demo', 'demo company', 'person demo', 'company demo') AS safe FROM v"""
)
def safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("email", F.concat(F.lit("x"), "o_orderkey", F.lit("@mail.example.com"))), ("email", F.concat(F.lit("y@"), "o_orderstatus", F.lit(".test"))), ("person", F.lit("PERSON-0001")), ("value", F.lit(" Demo Company ")), ("phone", F.concat(F.lit("tel-"), "o_orderkey"))]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs))))
    return rows.withColumn("safe", C.is_safe(F.col("kind"), F.col("value")))


@query("""SELECT p_partkey, p_name AS value FROM part WHERE lower(regexp_replace(p_name, '[^A-Za-z0-9_]+', '', 'g')) NOT IN (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9_]+', '', 'g')) FROM part WHERE p_size = 1)""")
def unprotected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    values = part.select("p_partkey", F.lit("value").alias("kind"), F.col("p_name").alias("value"))
    return R.unprotected(values, part.filter("p_size = 1").select(F.col("p_name").alias("target"))).select("p_partkey", "value")


@query(
    """WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber * 5 AS s, l_linenumber * 5 + CAST(l_quantity AS INT) % 9 + 1 AS e, l_linenumber AS n FROM lineitem)
    SELECT a.doc_id, a.s AS start, a.e AS "end" FROM i a WHERE a.n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM i b WHERE b.n % 2 = 1 AND a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e)"""
)
def spans_not_overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval anti-join within documents."""
    n = F.col("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n * 5).alias("start"), (n * 5 + F.col("l_quantity").cast("int") % 9 + 1).alias("end"), n.alias("n"))
    return R.not_overlapped(spans.filter("n % 2 = 0").drop("n"), spans.filter("n % 2 = 1"))


@query(
    """WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber * 5 AS s, l_linenumber * 5 + CAST(l_quantity AS INT) % 19 + 1 AS e, l_linenumber AS n FROM lineitem)
    SELECT a.doc_id, a.s AS start, a.e AS "end" FROM i a WHERE a.n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM i b WHERE b.n % 2 = 1 AND a.doc_id = b.doc_id AND b.s <= a.s AND a.e <= b.e)"""
)
def spans_not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n * 5).alias("start"), (n * 5 + F.col("l_quantity").cast("int") % 19 + 1).alias("end"), n.alias("n"))
    return R.not_contained(spans.filter("n % 2 = 0").drop("n"), spans.filter("n % 2 = 1"))


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_brand || '.'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'DOCUMENT-001') AS file FROM part""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.label_file(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("."))).alias("file"))


@query("""SELECT p_partkey, replace(replace(replace(p_name || '|' || p_brand || chr(13) || chr(10) || p_type, '|', '\\|'), chr(13) || chr(10), chr(10)), chr(10), '<br>') AS cell FROM part""")
def escaped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.escape_cell(F.concat("p_name", F.lit("|"), "p_brand", F.lit("\r\n"), "p_type")).alias("cell"))


@query("""SELECT c_custkey, CASE WHEN length(trim(c_name)) <= 6 THEN repeat('*', length(trim(c_name))) ELSE left(trim(c_name), 3) || '…' || right(trim(c_name), 3) END AS preview FROM customer""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", C.preview(F.col("c_name")).alias("preview"))


@query(
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice % 500 AS l, l_quantity AS t, CASE WHEN l_linenumber = 1 THEN -1.0 ELSE l_quantity * 2 END AS confidence FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(trunc(greatest(0, l - 3)) AS INT) AS "left", CAST(trunc(greatest(0, t - 2)) AS INT) AS top, CAST(trunc(least(520, l + 43)) AS INT) AS "right", CAST(trunc(least(60, t + 14)) AS INT) AS bottom
    FROM w WHERE NOT (confidence >= 0 AND confidence < 45)"""
)
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words confident enough, as padded boxes inside the image."""
    x, y = F.col("l_extendedprice") % 500, F.col("l_quantity")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), F.when(F.col("l_linenumber") == 1, -1.0).otherwise(y * 2).alias("confidence"), F.lit("w").alias("text"))
    box = R.padded_box(F.col("x"), F.col("y"), F.col("x") + 40, F.col("y") + 12, F.lit(520.0), F.lit(60.0))
    return R.confident_boxes(boxes).select("l_orderkey", "l_linenumber", F.inline(F.array(box)))


@query("""SELECT o_orderkey, greatest(1, least(200, CASE WHEN o_totalprice % 2 <= 1 THEN CAST(trunc(200 * (o_totalprice % 2)) AS INT) ELSE CAST(trunc(o_totalprice % 300) AS INT) END)) AS height FROM orders""")
def header_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    share = F.when(price % 2 <= 1, price % 2).otherwise(F.greatest(price % 300, F.lit(1.0000001)))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.header_height(F.lit(200), share).alias("height"))
