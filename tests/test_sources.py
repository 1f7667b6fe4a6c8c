import hashlib
import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.operators import columns as O
from maskwright.operators import relations as R
from maskwright.operators.boxes import fitting
from maskwright.operators.matching import Rule
from maskwright.__main__ import main
from maskwright.operators.session import Session, Suggestion
from maskwright.plans.pipeline import Options, Refused, check_paths, run_corpus, run_file, shown, text_output
from maskwright.sources.files import NO_TEXT, RECOGNISED, Reading, Unsupported, page_text, pages_markdown, render
from maskwright.sources.office import Xlsx
from maskwright.sources.rules import load_rules, parse_json, parse_rule
from maskwright.sources.tables import trim_edges
from maskwright.streaming.streams import anonymize_stream, counts_by_window


W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:wp="http://wp"'


def docx():
    def run(text, style=""):
        return f"<w:r><w:rPr>{style}</w:rPr><w:t>{text}</w:t></w:r>"

    body = (
        f"<w:p>{run('Ana', '<w:b/>')}{run(' Pérez', '<w:i/>')}<w:del>{run('gone')}</w:del></w:p>"
        f"<w:tbl><w:tr><w:tc><w:p>{run('Proveedor')}</w:p></w:tc><w:tc><w:p>{run('Compañía Demo')}</w:p></w:tc></w:tr></w:tbl>"
        '<w:p><w:r><wp:docPr descr="Luis Gómez"/></w:r></w:p><w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:footerReference w:type="default" r:id="f1"/></w:sectPr>'
    )
    with io.BytesIO() as out:
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
            z.writestr("word/_rels/document.xml.rels", '<R><x Id="h1" Target="header1.xml"/><x Id="f1" Target="footer1.xml"/></R>')
            z.writestr("word/header1.xml", f"<w:hdr {W}><w:p>{run('Juan Pérez')}</w:p></w:hdr>")
            z.writestr("word/footer1.xml", f"<w:ftr {W}><w:p>{run('juan@correo.test')}</w:p></w:ftr>")
            z.writestr("word/comments.xml", f"<w:comments {W}>{run('Eva Ruiz')}</w:comments>")
        return out.getvalue()


def xlsx():
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Compañía Demo</t></is></c></row><row r="2"><c r="A2"><v>5</v></c><c r="B2"><v>1.5</v></c></row>'
    with io.BytesIO() as out:
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="Synthetic" r:id="a"/><sheet name="None" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<R><x Id="a" Target="worksheets/sheet1.xml"/><x Id="b" Target="worksheets/sheet2.xml"/></R>')
            z.writestr("xl/sharedStrings.xml", "<sst><si><t>Proveedor</t></si></sst>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
            z.writestr("xl/worksheets/sheet2.xml", "<worksheet><sheetData/></worksheet>")
        return out.getvalue()


def test_docx():
    out = render(docx(), ".docx", Session())
    assert "**PERSON-0001**" in out and "## Header" in out and "EMAIL-0001@example.com" in out and "## Text alternatives" in out and "## Comments" in out
    for value in ("Ana", "Pérez", "juan@", "gone", "Compañía Demo", "Luis", "Eva"):
        assert value not in out


def test_xlsx():
    out = render(xlsx(), ".xlsx", Session())
    assert "COMPANY-0001" in out and "Compañía Demo" not in out and "_Empty sheet._" in out
    assert next(Xlsx(xlsx()).sheets())[1] == [["Proveedor", "Compañía Demo"], [5, 1.5]]


def test_csv_contexts_and_ragged_rows():
    out = render("﻿Nombre,x\nana perez,1,2\nProveedor,Compañía Demo\n|,\"a\nb\"\n".encode(), ".csv", Session())
    assert "﻿" not in out and "ana perez" not in out and "COMPANY-" in out and r"\|" in out and "a<br>b" in out
    assert render(b"a\tb\n", ".tsv", Session()).splitlines()[2] == "| a | b |"
    assert trim_edges([["", "a", ""], [None, "", ""]]) == [["", "a"]]


def test_unknown_and_missing():
    for suffix in (".exe", ".pdf", ".png"):
        with pytest.raises(Unsupported):
            render(b"", suffix, Session())


def test_rules():
    assert parse_rule(" a = b=c ") == Rule("a", "b=c") and parse_rule("a=").target == ""
    for bad in ("a", " =b"):
        with pytest.raises(ValueError):
            parse_rule(bad)
    assert parse_json('{"a": "b"}') == [Rule("a", "b")]
    assert parse_json('[{"from": "a", "to": "b", "smart": false}]', case_sensitive=True) == [Rule("a", "b", True, False)]
    with pytest.raises(ValueError):
        parse_json('[{"from": "a"}]')
    assert [r.source for r in load_rules(["a=b"], '{"c": "d"}')] == ["a", "c"]


def test_single_file(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("Ana Pérez; persona@example.test; Empresa: Organización Sintética", encoding="utf-8")
    before = hashlib.sha256(source.read_bytes()).hexdigest()
    report = tmp_path / "out" / "report.json"
    target = run_file(spark, str(source), str(tmp_path / "out" / "x.md"), str(report))
    assert hashlib.sha256(source.read_bytes()).hexdigest() == before
    told = report.read_text(encoding="utf-8")
    assert json.loads(told)["document_label"] == "DOCUMENT-001"
    for text in (told, open(target, encoding="utf-8").read()):
        assert "Ana" not in text and "persona@" not in text and "Sintética" not in text


def test_fail_closed(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("texto sin datos detectables.", encoding="utf-8")
    with pytest.raises(Refused):
        run_file(spark, str(source), str(tmp_path / "o" / "out.md"))
    assert not (tmp_path / "o").exists()
    source.write_text("synthetic secret\n", encoding="utf-8")
    rules = (Rule("secret", "redacted", fuzzy_threshold=0.0), Rule("other", "x", fuzzy_threshold=0.0))
    with pytest.raises(Refused, match="rule-002"):
        run_file(spark, str(source), str(tmp_path / "o2.md"), options=Options(rules, require_all_rules=True))
    report = tmp_path / "r.json"
    target = run_file(spark, str(source), str(tmp_path / "o2.md"), str(report), Options(rules))
    assert open(target).read() == "synthetic redacted\n" and json.loads(report.read_text())["total_rule_matches"] == 1
    with pytest.raises(ValueError):
        Options((Rule("a", "b", fuzzy_threshold=2.0),))


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in.md"
    source.write_text("**Acme S.A.** y otro", encoding="utf-8")
    assert main([str(source), "-o", str(tmp_path / "out.md"), "--replace", "Acme SA=Demo Company", "--enable-ner", "--ner-model", "https://example.invalid/m", "--report", str(tmp_path / "r.json")]) == 0
    assert "Demo Company" in (tmp_path / "out.md").read_text() and json.loads((tmp_path / "r.json").read_text())["ner"]["error"] == "remote model paths are disabled"
    assert main([str(source), "-o", str(source)]) == 2 and main([str(source), "--format", "images"]) == 2
    assert main([str(source), "--replace", "no equals sign"]) == 2
    assert shown([Suggestion("email", "v", "t", "r", 0.5)] * 22)[-1] == "  ... and 2 more suggestions"


def test_paths(tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("x")
    os.symlink(a, tmp_path / "s.txt")
    os.link(a, tmp_path / "h.txt")
    for alias in ("a.txt", "./a.txt", "s.txt", "h.txt"):
        with pytest.raises(ValueError):
            check_paths(str(a), [f"{tmp_path}/{alias}"])
        with pytest.raises(ValueError):
            check_paths(str(a), [str(tmp_path / "b")], f"{tmp_path}/{alias}")
    with pytest.raises(ValueError):
        check_paths(str(a), [str(tmp_path / "b")], str(tmp_path / "b"))
    assert text_output("/x/in.txt", "/y") == "/y/document.masked.md"


def test_corpus(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("**Ana Pérez**", encoding="utf-8")
    (folder / "b.txt").write_text("nada", encoding="utf-8")
    (folder / "c.docx").write_bytes(docx())
    (folder / "d.docx").write_bytes(b"no zip")
    status = {os.path.basename(r.path): r.status for r in run_corpus(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "rep")).collect()}
    assert status == {"a.md": "passed", "b.txt": "refused", "c.docx": "passed", "d.docx": "refused"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and spark.read.parquet(str(tmp_path / "rep")).count() == 4


def test_nothing_of_refused_documents_is_written(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.md").write_text("Ana writes from ana@correo.test", encoding="utf-8")
    (folder / "bad.md").write_text("SECRETWORD and x@hidden.test stay, unmasked phrase zebra", encoding="utf-8")
    options = Options((Rule("ana", "demo", fuzzy_threshold=0.0),), require_all_rules=True)
    status = {os.path.basename(r.path): r.status for r in run_corpus(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "rep"), options).collect()}
    assert status == {"good.md": "passed", "bad.md": "refused"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and spark.read.parquet(str(tmp_path / "rep")).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out", "rep"]
    seen = [r.asDict() for name in ("out", "out/_status", "rep") for r in spark.read.parquet(str(tmp_path / name)).collect()]
    assert "zebra" not in str(seen) and "hidden" not in str(seen) and "SECRETWORD" not in str(seen)
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark says when the output is there
        run_corpus(spark, str(folder), str(tmp_path / "out"), options=options)
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name]


class Page:
    def __init__(self, blocks, plain=""):
        self.blocks, self.plain = blocks, plain

    def get_text(self, kind):
        return {"blocks": self.blocks} if kind == "dict" else self.plain


def test_pages_with_and_without_text():
    spans = lambda *t: {"spans": [{"text": x} for x in t]}
    pages = [Page([{"type": 0, "lines": [spans("Ana ", "Pérez"), spans("x")]}, {"type": 1}]), Page([], "plain"), Page([])]
    assert page_text(pages[0]) == "Ana Pérez\nx" and page_text(pages[1]) == "plain"
    read = lambda how: pages_markdown(pages, Session(), "L", how, lambda page: " read by eye ")
    assert read(Reading()) == f"# L\n\n## Page 1\n\nPERSON-0001\nx\n\n## Page 2\n\nplain\n\n## Page 3\n\n{NO_TEXT}\n"
    assert read(Reading(ocr=True)).endswith(f"## Page 3\n\n{RECOGNISED}\n\nread by eye\n")
    assert read(Reading(force_ocr=True)).count("read by eye") == 3


def test_size_of_fitted_text():
    assert fitting((200, 40), lambda n: (6 * n, n)) == 30 and fitting((60, 40), lambda n: (6 * n, n)) == 9
    assert fitting((5, 5), lambda n: (6 * n, n)) == 6 and fitting((500, 8), lambda n: (n, n / 3)) == 8


def test_command_line_flags(tmp_path, capsys):
    source = tmp_path / "a.md"
    source.write_text("Mail ana@correo.test", encoding="utf-8")
    assert main(["--help-install"]) == 0 and "pymupdf" in capsys.readouterr().out
    for argv in (["--safe-report", "--unsafe-report", str(source)], []):
        with pytest.raises(SystemExit):
            main(argv)


def test_intervals_against_all_pairs(spark):
    r = random.Random(4)
    make = lambda n: [(r.choice([1, 2, 3, None]), a := r.randrange(30), a + r.randrange(1, 8), i) for i in range(n)]
    left, right = make(60), make(25)
    kind = "doc_id long, start int, end int, n int"
    spans, by = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    same = lambda a, b: a[0] is not None and a[0] == b[0]
    apart = {a[3] for a in left if not any(same(a, b) and a[1] < b[2] and b[1] < a[2] for b in right)}
    outside = {a[3] for a in left if not any(same(a, b) and b[1] <= a[1] and a[2] <= b[2] for b in right)}
    assert {x.n for x in R.not_overlapped(spans, by).collect()} == apart
    assert {x.n for x in R.not_contained(spans, by).collect()} == outside and R.not_contained(spans, by).columns == spans.columns


def test_units_share_numbers(spark):
    units = spark.createDataFrame([(1, 2, None, "Ana Pérez"), (1, 1, None, "Luis Gómez"), (2, 1, None, "Ana Pérez"), (2, 2, None, None)], "doc_id long, unit_no int, markup string, text string")
    out = {(r.doc_id, r.unit_no): r.text for r in O.anonymize_units(units).collect()}
    assert out == {(1, 1): "PERSON-0001", (1, 2): "PERSON-0002", (2, 1): "PERSON-0001", (2, 2): None}


def test_sql_functions_and_partitions(spark):
    O.register(spark)
    df = spark.createDataFrame([(i, f"Nota {i} de Ana Pérez") for i in range(20)] + [(99, None)], "doc_id long, text string")
    df.createOrReplaceTempView("d")
    assert spark.sql("SELECT sum(size(detect_spans(text))) AS n FROM d").first().n > 0
    outs = [sorted((r.doc_id, str(r.result.text)) for r in O.anonymize(df.repartition(n)).collect()) for n in (1, 7)]
    assert outs[0] == outs[1]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "Ana Pérez"), (2, "2024-01-01 12:00:00", "x")], "id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = counts_by_window(anonymize_stream(stream), "ts").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.n_automatic, r.n_events) for r in spark.table("counted").collect()} == {(1, 1), (0, 1)}
