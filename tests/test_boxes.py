import pytest

from maskwright.operators.boxes import Redaction, page_redactions, parse_color, parse_region, redactions, word_redactions
from maskwright.operators.matching import Rule, WordBox
from maskwright.operators.session import Session
from maskwright.sources.images import recognised, redact_files, text_layer
from maskwright.sources.models import load_model


def line(text):
    return [WordBox(w, 50.0 * i, 10.0, 50.0 * i + 40, 20.0) for i, w in enumerate(text.split())]


def test_regions_and_colours():
    assert parse_color("#ff0010") == (255, 0, 16)
    assert parse_region("1, 2.5,3,4= Name ") == Redaction(1, 2, 4, 6, "Name", "region")
    for bad in ("1,2,3", "a,b,c,d", "1,2,0,4"):
        with pytest.raises(ValueError):
            parse_region(bad)
    with pytest.raises(ValueError):
        parse_color("#12")
    assert [r[:4] for r in page_redactions(100, 80, 0.5, regions=["90,70,50,50"])] == [(0, 0, 100, 40), (90, 70, 100, 80)]
    assert page_redactions(100, 80, 500)[0].bottom == 80


def test_rules_come_first_and_words_are_used_once():
    session = Session([Rule("Acme SA", "Demo", fuzzy_threshold=0)])
    out = word_redactions(line("From Acme S.A. to Ana Pérez 6000-0000"), session, 300, 25)
    assert [(r.text, r.kind) for r in out][:1] == [("Demo", "rule")] and session.matches[0] == 1
    assert {r.kind for r in out} >= {"rule", "phone"} and any(r.text.startswith("PERSON-") for r in out)
    assert all(0 <= r.left < r.right <= 300 and 0 <= r.top < r.bottom <= 25 for r in out)


def test_words_of_pages():
    data = {"text": ["a", " ", "b", "c"], "conf": ["90", "90", "10", "x"], "left": [0] * 4, "top": [0] * 4, "width": [5] * 4, "height": [5] * 4}
    assert [b.text for b in recognised(data, 45)] == ["a", "c"]
    boxes = text_layer([(72, 0, 144, 10, "two", 0, 0, 1), (0, 0, 36, 10, "one", 0, 0, 0)], 144)
    assert [(b.text, b.right) for b in boxes] == [("one", 72.0), ("two", 288.0)]


def test_redactions_as_column(spark):
    words = [b._asdict() for b in line("mail ana@correo.test")]
    df = spark.createDataFrame([(1, words, 200, 30), (2, None, 200, 30)], "id int, words array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>, width int, height int")
    out = {r.id: r.r for r in df.select("id", redactions(header=0.1)("words", "width", "height").alias("r")).collect()}
    assert [x.kind for x in out[1]] == ["email", "header"] and [x.kind for x in out[2]] == ["header"]


def test_missing_libraries_are_told(spark):
    files = spark.createDataFrame([("a.png", bytearray(b"x")), ("b.zip", bytearray(b""))], "path string, content binary")
    assert all(r.error for r in redact_files(files).collect())
    model, told = load_model("https://example.invalid/model")
    assert model is None and told.error == "remote model paths are disabled" and told.report()["fallback"]
    assert load_model("/no/such/path")[1].error == "local NER model path does not exist"
