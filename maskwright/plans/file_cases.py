"""Queries over files, pictures' words and event time, built from table rows, each with the SQL of its result."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boxes import redactions
from ..operators.matching import Rule
from ..operators.physical import spread
from ..sources.files import anonymize_files
from ..streaming.streams import anonymize_stream, counts_by_window
from .pipeline import Options, gated

_KEY = "CAST(s_suppkey AS STRING)"
_NO = "lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0')"

#: Kind of file, SQL of its content, and what it becomes; {L} stands for the label.
KINDS = [
    (".csv", f"'Name,Phone,Note' || chr(10) || 'Ana Pérez,6000-' || {_NO} || ',a|b' || chr(10)", "# {L}\n\n| Name | Phone | Note |\n| --- | --- | --- |\n| PERSON-0001 | PHONE-0001 | a\\|b |\n"),
    (".tsv", f"'Cuenta' || chr(9) || 'Email' || chr(10) || '00' || lpad({_KEY}, 8, '0') || chr(9) || 'u' || {_KEY} || '@mail.test'", "# {L}\n\n| Cuenta | Email |\n| --- | --- |\n| ACCOUNT-0001 | EMAIL-0001@example.com |\n"),
    (".txt", f"'Teléfono: 6000-' || {_NO} || chr(13) || chr(10) || 'fin'", "Teléfono: PHONE-0001\nfin"),
    (".md", f"'**Ana Pérez** `u' || {_KEY} || '@mail.test`'", "**PERSON-0001** `EMAIL-0001@example.com`"),
    (".html", "'<p>Ana <b>Pérez</b></p>'", "<p>PERSON-0001<b></b></p>"),
    (".json", f"'{{\"email\": \"u' || {_KEY} || '@mail.test\"}}'", '{"email": "EMAIL-0001@example.com"}'),
    (".log", "'nothing to see'", "nothing to see"),
    (".bin", "'x'", None),
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file of each kind for every supplier."""
    suppliers = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
    made = [F.struct(F.expr(f"'/files/' || {_KEY} || '{suffix}'").alias("path"), F.expr(content).cast("binary").alias("content")) for suffix, content, _ in KINDS]
    return suppliers.select(F.inline(F.array(*made)))


def masked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind as text: tables in Markdown, markup kept, unknown kinds as errors, neutral labels."""
    return anonymize_files(_files(spark, sf_dir)).select("path", "label", "error", "text")


def gated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files pass: none without a replacement, none that cannot be read."""
    return gated(anonymize_files(_files(spark, sf_dir)), Options()).select("path", "status", F.array_join("problems", "; ").alias("problems"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{L}", "' || label || '") + "'"


def _files_sql() -> str:
    rows = []
    for suffix, _, text in KINDS:
        error = "NULL" if text is not None else f"'unsupported file type ''{suffix}'''"
        rows.append(f"SELECT path, label, {error} AS error, {_quoted(text) if text is not None else 'NULL'} AS text FROM (SELECT path, 'DOCUMENT-' || substr(sha256(path), 1, 12) AS label FROM (SELECT '/files/' || s_suppkey || '{suffix}' AS path FROM supplier))")
    return " UNION ALL ".join(rows)


def _gate_sql() -> str:
    rows = []
    for suffix, _, text in KINDS:
        status, problem = ("refused", f"not read: unsupported file type ''{suffix}''") if text is None else ("refused", "zero replacements/redactions matched") if suffix == ".log" else ("passed", "")
        rows.append(f"SELECT '/files/' || s_suppkey || '{suffix}' AS path, '{status}' AS status, '{problem}' AS problems FROM supplier")
    return " UNION ALL ".join(rows)


def _zipped(parts: dict[str, str]) -> bytes:
    with io.BytesIO() as out:
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return out.getvalue()


def _docx() -> bytes:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda text, style="": f"<w:r><w:rPr>{style}</w:rPr><w:t>{text}</w:t></w:r>"
    body = f"<w:p>{run('Ana', '<w:b/>')}{run(' Pérez', '<w:i/>')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('Proveedor')}</w:p></w:tc><w:tc><w:p>{run('Compañía Demo')}</w:p></w:tc></w:tr></w:tbl>"
    return _zipped({"word/document.xml": f"<w:document {space}><w:body>{body}</w:body></w:document>"})


def _xlsx() -> bytes:
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda place, text: f'<c r="{place}" t="inlineStr"><is><t>{text}</t></is></c>'
    return _zipped({
        "xl/workbook.xml": f'<workbook {space}><sheets><sheet name="Sheet" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {space}><sheetData><row r="1">{cell("A1", "Proveedor")}{cell("B1", "Compañía Demo")}</row><row r="2">{cell("A2", "Email")}{cell("B2", "ana@correo.test")}</row></sheetData></worksheet>',
    })


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document and a workbook for every region: runs with their styles, tables, sheets."""
    made = [F.struct(F.concat(F.lit("/office/"), F.col("r_regionkey").cast("string"), F.lit(suffix)).alias("path"), F.lit(content).alias("content")) for suffix, content in ((".docx", _docx()), (".xlsx", _xlsx()))]
    files = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.inline(F.array(*made)))
    return anonymize_files(files, label="L").select("path", "error", "text")


# ---- words of pictures --------------------------------------------------------------
_WORDS = ("Ana", "Pérez", "tel", None, "Acme,", "S.A.", "end")  # None: a phone number of the row


def covered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is covered on a page of positioned words: rules, detections, a header and a region."""
    number = F.concat(F.lit("6000-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"))
    place = lambda i: {"left": 10.0 * i, "top": 5.0, "right": 10.0 * i + 8, "bottom": 15.0, "confidence": 90.0}
    words = F.array(*(F.struct((number if w is None else F.lit(w)).alias("text"), *(F.lit(v).alias(k) for k, v in place(i).items())) for i, w in enumerate(_WORDS)))
    cover = redactions((Rule("Acme SA", "Demo Company", fuzzy_threshold=0.0),), header=0.1, header_text="TOP", regions=("5,5,20,10=Logo",))
    pages = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")).select("s_suppkey", words.alias("words"))
    return pages.select("s_suppkey", F.inline(cover(F.col("words"), F.lit(200), F.lit(100))))


# ---- event time -----------------------------------------------------------------------
def windowed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements per hour of event time; the functions of the streams on a table."""
    text = "if(user_id % 3 = 0, 'no value', concat('user u', user_id, '@mail.test and 6000-', lpad(CAST(user_id % 10000 AS STRING), 4, '0')))"
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id")).select("ts", F.expr(text).alias("text"))
    counts = counts_by_window(anonymize_stream(events), "ts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n_automatic", "n_events")


QUERIES = {f.__name__: f for f in (masked_files, gated_files, office_files, covered_words, windowed_masks)}

SQL = {
    "masked_files": _files_sql(),
    "gated_files": _gate_sql(),
    "office_files": """SELECT '/office/' || r_regionkey || '.docx' AS path, NULL AS error, '# L' || chr(10) || chr(10) || '**PERSON-0001**' || chr(10) || chr(10) || '| Proveedor | COMPANY-0001 |' || chr(10) || '| --- | --- |' || chr(10) AS text FROM region
        UNION ALL SELECT '/office/' || r_regionkey || '.xlsx', NULL, '# L' || chr(10) || chr(10) || '## Sheet' || chr(10) || chr(10) || '| Proveedor | COMPANY-0001 |' || chr(10) || '| --- | --- |' || chr(10) || '| Email | EMAIL-0001@example.com |' || chr(10) FROM region""",
    "covered_words": """SELECT s_suppkey, CAST(l AS INT) AS "left", CAST(t AS INT) AS top, CAST(r AS INT) AS "right", CAST(b AS INT) AS bottom, x AS text, k AS kind FROM supplier,
        (VALUES (37, 3, 61, 17, 'Demo Company', 'rule'), (27, 3, 41, 17, 'PHONE-0001', 'phone'), (0, 3, 21, 17, 'PERSON-0001', 'person'), (0, 0, 200, 10, 'TOP', 'header'), (5, 5, 25, 15, 'Logo', 'region')) AS c(l, t, r, b, x, k)""",
    "windowed_masks": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS n_automatic, count(*) AS n_events FROM events GROUP BY 1""",
}
