"""The whole pipeline against plain Python, and odd rows through it."""

import hashlib
import zlib

import numpy as np
from test_methods import words

import corpus_pipeline
from maskwright.llm import pii, quality_crf
from maskwright.llm.packing import cuts, default_tokenizer, encoder
from maskwright.llm.storage import keep

SF = "/root/testdata/sf0.001"


def known(row):
    values = [None if row[c] is None else str(row[c]) for c in ("doc_id", "text", "lang", "source")]
    told = "".join("-" if v is None else hashlib.sha256(v.encode()).hexdigest() for v in values)
    return hashlib.sha256(told.encode()).digest()[:16]


def test_rows_that_differ_in_a_null_column_are_two(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "x", None, 0), (1, None, None, "x", 0), (1, "", "x", None, 0), (None, None, None, None, 0), (2, "x;1:y", "z", None, 5), (2, "x", "y;1:z", None, 5)]
    docs = spark.createDataFrame(rows + rows[:1], kind)
    tagged, row = corpus_pipeline._known(docs)
    assert {bytes(r[row]) for r in tagged.collect()} == {known(r) for r in docs.collect()} and tagged.select(row).distinct().count() == len(rows)
    # texts with the same words are one group, of which one stays; those without words all stay, but for the repeated row
    assert corpus_pipeline.deduplicate(spark, docs, str(tmp_path)).count() == len(rows)


def test_pipeline_against_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    good = quality_crf.train(docs, labels).score([r["text"] for r in rows]) >= quality_crf.CUT
    rows = [r for r, g in zip(rows, good, strict=True) if g]
    assert len(rows) > 50

    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    ids = [known(r) for r in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) or ids[i] == ids[j]:
                group[find(i)] = find(j)
    first: dict[int, int] = {}
    for i in range(len(rows)):
        k = first.setdefault(find(i), i)
        if ids[i] < ids[k]:
            first[find(i)] = i
    rows = [rows[i] for i in first.values()]

    windows: dict[int, set] = {}
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(b.text)
        if n := min(13, len(w)):
            windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    clean = []
    for r in rows:
        w = words(r["text"])
        hit = {i + k for n, own in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)

    maps, enc, want = pii.Surrogates(pii.DEFAULT_KEY), encoder(default_tokenizer()), set()
    for r in clean:
        parts, at = [], 0
        for a, b, kind in pii.find(r["text"]):
            parts += [r["text"][at:a], maps.replace(kind, r["text"][a:b])]
            at = b
        tokens = np.array([*enc.exact.encode("".join([*parts, (r["text"] or "")[at:]]), add_special_tokens=False).ids, 2], "<u4")
        want |= {(r["doc_id"], k, a, b - a, zlib.crc32(tokens[a:b].tobytes())) for k, (a, b) in enumerate(cuts(len(tokens), 1024))}

    out = keep(corpus_pipeline.run(spark, SF), "packed").collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    bins: dict[int, list] = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    assert len(bins) <= 1.05 * sum(r.length for r in out) / 1024 + 1
