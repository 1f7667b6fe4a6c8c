"""Column expressions against the functions on strings that they stand for."""

import random

from pyspark.sql import functions as F

from maskwright.functions import columns as C
from maskwright.functions import text as X
from maskwright.functions import vocabulary as V

PARTS = ["a@x.test", "b.c@mail.example.com", "x", " ", ",", ";", "@", ".", "-", "6000-0000", "+507 ", "(743) ", "555-3824", "12345678", "1", "é", "507-", "10.1.2.3", "\n", "_"]


def made(spark, n=400, seed=1):
    r = random.Random(seed)
    texts = ["".join(r.choices(PARTS, k=r.randrange(0, 9))) for _ in range(n)] + ["a@x.test starts", "a@x.test b@x.test c@x.test", "a@x.test", ""]
    return texts, spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def test_native_values_are_those_of_the_patterns(spark):
    texts, df = made(spark)
    for kind, pattern in (("email", V.EMAIL), ("phone", V.PHONE)):
        got = {r.i: (r.v, r.n) for r in df.select("i", C.native_values(F.col("t"), kind).alias("v"), C.native_count(F.col("t"), kind).alias("n")).collect()}
        for i, t in enumerate(texts):
            want = [m[0] for m in pattern.finditer(t)]
            assert got[i] == (want, len(want)), t


def test_native_redaction_leaves_no_value(spark):
    texts, df = made(spark)
    for r in df.select("t", C.native_redact(F.col("t"), ("email",)).alias("o")).collect():
        assert r.o == V.EMAIL.sub("[EMAIL]", r.t)
    nulls = spark.createDataFrame([(None,)], "t string").select(C.native_redact(F.col("t")).alias("o"), C.native_count(F.col("t"), "email").alias("n")).first()
    assert nulls.o is None and nulls.n is None


def test_forms_of_values(spark):
    values = ["Straße", "ΟΔΟΣ ς", " Ana  Pérez ", "ſafe", "K", "ACME, S. A.", "PERSON-0001", "abc@demo.local", "x@y.example.com", "", "12", "Old Name", "oLd", "OLD", "old", "McName", "Él", "éL"]
    df = spark.createDataFrame([(v, k) for v in values for k in ("value", "person", "email")], "v string, k string")
    rows = df.select("v", "k", C.canonical(F.col("k"), F.col("v")).alias("c"), C.preview(F.col("v")).alias("p"), C.is_safe(F.col("k"), F.col("v")).alias("s"), C.case_class(F.col("v")).alias("case")).collect()
    for r in rows:
        assert r.c == X.canonical(r.k, r.v) and r.p == X.preview(r.v) and r.s == X.is_safe(r.k, r.v) and r.case == X.case_class(r.v), r
