"""Operators against plain Python, on small random inputs and planted cases."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import decontaminate as D
from maskwright.llm import html_extract, ngram_join, pii, quality_crf, quality_rules, secret_scan, storage
from maskwright.llm.html_extract import Wrapper, align, expression, fold, main_text, read
from maskwright.llm.license_scan import NOTICES, _scan, license_report
from maskwright.llm.ngram_join import choose_bands, near_duplicates
from maskwright.llm.packing import best_fit, cuts, default_tokenizer, encoder, pack
from maskwright.llm.tokens import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zZ09.é\n🙂ß", max_size=40)), max_size=8))
def test_words_and_shingles(texts):
    w = Words(texts)
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    names = {}
    for h, word in zip(w.hashes.tolist(), (x for t in texts for x in words(t)), strict=True):
        assert names.setdefault(h, word) == word
    assert len(set(names.values())) == len(names)
    grams, bounds = w.shingles(3)
    want = [len(words(t)) - 2 if len(words(t)) > 2 else int(bool(words(t))) for t in texts]
    assert np.diff(bounds).tolist() == want and len(grams) == sum(want)


def test_words_longer_than_a_window():
    a, b = "x" * 3_000_000, "x" * 2_999_999 + "y"
    w = Words([a, a + " z", b])
    assert w.counts.tolist() == [1, 2, 1] and w.hashes[0] == w.hashes[1] != w.hashes[3]


@pytest.mark.parametrize(("large", "block"), [(128, 1024), (8, 16)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, large, block):
    monkeypatch.setattr(ngram_join, "LARGE", large)  # the lower ones: families, in several blocks
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(rng.randrange(3, 60))] for _ in range(40)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 5)):
            c = list(b)
            for _ in range(rng.randrange(0, 3)):
                c[rng.randrange(len(c))] = "new" + str(rng.randrange(9))
            texts.append(" ".join(c))
    # a family of near copies, and one of texts that share a passage only
    shared = " ".join(f"p{i}" for i in range(30))
    texts += [shared + " " + " ".join(f"q{i}x{k}" for k in range(25 + i % 9)) for i in range(60)]
    hot = [f"w{i}" for i in range(120)]
    texts += [" ".join(hot[:i] + ["changed"] + hot[i + 1 :]) for i in range(3, 118)] * 2
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    linked = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    rows = {r.doc_id: r for r in near_duplicates(frame(spark, texts)).collect()}
    group = {i: {j for j, s in enumerate(sets) if linked(sets[i], s)} for i in range(len(texts))}
    for i, s in enumerate(sets):
        others = [j for j in group[i] if sets[j] != s]
        assert (rows[i].class_id, rows[i].n_copies, rows[i].n_links) == (sets.index(s), sets.count(s), len(others))
        assert rows[i].link_id == (min(rows[j].class_id for j in others) if others else None)
        reach = {i}
        while more := set().union(*(group[j] for j in reach)) - reach:
            reach |= more
        assert rows[i].group_id == min(reach)


def test_rows_grow_with_the_members_of_a_group(spark, monkeypatch):
    rows = {}

    def counted(df, name):
        out = storage.keep(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "keep", counted)
    seen = {}
    for n in (200, 400, 800):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(150)]
        texts = [" ".join(w if rng.random() > 0.012 else f"new{rng.randrange(10**6)}" for w in base) for _ in range(n)]
        rows.clear()
        found = ngram_join.near_duplicates(frame(spark, texts)).collect()
        assert len(found) == n and sum(r.n_links for r in found) > 0.1 * n * n
        seen[n] = dict(rows)
    # at most a row for each band, or an edge in both directions
    assert all(held <= 44 * n for n, by_name in seen.items() for held in by_name.values()), seen
    assert seen[800]["family-blocks"] == 1 and seen[800]["links"] <= 800 * 2


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 128


def test_decontamination_against_plain_search(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25)))) for i in range(12)]
    texts = []
    for _ in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 80))
        for _, b in rng.sample(bench, 2):
            at = rng.randrange(len(w) + 1)
            w[at:at] = b.split()[rng.randrange(3) :]
        texts.append(" ".join(w))
    docs, items = frame(spark, texts).repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    for size, block in ((13, 1 << 20), (5, 40)):  # in one block, and in many
        for r in D.contamination(docs, items, size=size, block_chars=block).collect():
            w, hit, listed = words(texts[r.doc_id]), set(), set()
            for i, b in bench:
                b = words(b)
                n = min(size, len(b))
                windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        listed.add(str(i))
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(listed), bool(hit) and 20 * len(hit) >= len(w))


def test_long_items_and_binary_ids(spark):
    """Items longer than a piece keep every window; ids may be of any type."""
    rng = random.Random(8)
    item = [f"k{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(item[i : i + 13]) for i in range(0, 388, 3)] + [" ".join(item[380:392]), "é" * 50]
    docs = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "doc_id binary, text string").repartition(2)
    items = spark.createDataFrame([("x", " ".join(item)), ("y", None), ("z", "é" * 50)], "item_id string, text string")
    for words_ in (20, 64, 1 << 16):
        rows = {int(r.doc_id): r for r in D.contamination(docs, items, piece_words=words_, block_chars=300).collect()}
        assert len(rows) == len(texts) and all(rows[i].n_hit == 13 for i in range(len(texts) - 2))
        assert rows[len(texts) - 2].n_hit == 0 and rows[len(texts) - 1]["items"] == ["z"]


def test_proximity(spark):
    docs = frame(spark, ["a x x b", "a x x x x b", "b a", None])
    found = D.proximity_search(D.build_index(docs), ["a b"], 4).collect()
    assert sorted({r.doc_id for r in found}) == [0, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    bins, offsets, fills = best_fit(np.array(lengths, np.int64), 50)
    for b in range(len(fills)):
        own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at == fills[b] <= 50
    assert len(fills) <= 1.25 * -(-sum(lengths) // 50) + max(1, sum(n > 25 for n in lengths))


def test_cuts_and_rounds(spark):
    assert cuts(1, 4) == [(0, 1)] and cuts(8, 4) == [(0, 4), (4, 8)] and cuts(9, 4) == [(0, 1), (1, 5), (5, 9)]
    docs = frame(spark, ["word " * (i % 37) for i in range(400)]).repartition(8)
    for group_bins in (4, 4096):  # many small groups, or one
        rows = pack(docs, capacity=64, slack=2, group_bins=group_bins).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in bins.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and sum(n for _, n in own) <= 64
        assert len(bins) <= 1.12 * sum(r.length for r in rows) / 64


def test_pack_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc, want, total = encoder(default_tokenizer()), Counter(), 0
    for r in docs.collect():
        ids = np.array([*enc.exact.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first = len(ids) % 1024 or 1024
        cut = [0, *range(first, len(ids), 1024), len(ids)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)))
    out = pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    assert len(bins) <= 1.02 * total / 1024 + 1


def test_tokens_are_those_of_the_tokenizer():
    enc = encoder(default_tokenizer())
    for text in ("", "Hello  world\n\n x", "naïve façade 🙂 12345 don't", "<|endoftext|> a", " \t\n" * 50, "été" * 40):
        assert enc.ids(text) == enc.exact.encode(text, add_special_tokens=False).ids


def test_licenses(spark):
    texts = [f"foo bar {t} baz" for _, t in NOTICES] + ["Licensed under the Apache Foundation rules of many words", "x " * 300 + NOTICES[2][1] + " y" * 300 + " " + NOTICES[0][1]]
    # one word of a long notice changed: most of its shingles remain
    w = NOTICES[6][1].split()
    texts.append(" ".join(["start", *w[:1], "changed", *w[2:], "end"]))
    rows = {r.doc_id: r for r in license_report(frame(spark, texts)).collect()}
    for i, (name, _) in enumerate(NOTICES):
        assert name in rows[i].licenses.split(","), name
    n = len(NOTICES)
    assert rows[n].licenses == "" and rows[n + 1].licenses == "MIT" and rows[n + 1].spans.count("MIT") == 2
    assert "GPL-3.0-or-later" in rows[n + 2].licenses


@pytest.mark.parametrize("k", range(len(NOTICES)))
def test_license_in_a_text_alone_in_its_group(k):
    name, text = NOTICES[k]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([text, ""])], ["doc_id", "text"])
    first, empty = next(_scan(NOTICES, 0.8)(iter([batch]))).column("found").to_pylist()
    assert (name, 0, len(words(text))) in [(f["license"], f["first_word"], f["end_word"]) for f in first] and empty == []


@pytest.mark.parametrize("k", range(len(NOTICES)))
def test_part_of_a_license_alone_and_among_others(k):
    """The least part that counts, at either end, without neighbours and in the middle of a text."""
    name, text = NOTICES[k]
    w = words(text)
    m = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    part = -(-4 * m // 5) + 4 + (len(w) - 4 - m)  # words that hold four fifths of the shingles
    filler = [f"z{i}" for i in range(300)]
    for own in (w[:part], w[-part:]):
        for row in (own, filler + own + filler):
            batch = pa.record_batch([pa.array([1]), pa.array([" ".join(row)])], ["doc_id", "text"])
            assert name in {f["license"] for f in next(_scan(NOTICES, 0.8)(iter([batch]))).column("found").to_pylist()[0]}


def test_licenses_do_not_depend_on_partitions(spark):
    texts = [f"{'w ' * (7 * i % 40)}{t}{' v' * (i % 5)}" for i, (_, t) in enumerate(NOTICES)] + ["", None, "short text"]
    seen = [sorted(map(tuple, license_report(frame(spark, texts).repartition(n)).collect())) for n in (1, 3, 50)]
    assert seen[0] == seen[1] == seen[2]


BASE = (("assign", re.compile(secret_scan.ASSIGN)), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+")))


def test_secret_spans(spark):
    rng = random.Random(7)
    parts = ["password: hunter2hunter2", "api_key='AbC.+/=_-12'", "token=abc", "secret = x1y2z3", "AKIA" + "A1" * 8, "AKIASHORT", "deadbeef" * 3, "cafe", "🙂", "é\n", "TOKEN=token:abcdef", "e8u86WLTuC9ER74B6nG197bw", "internationalizationManager", "4785380592391135", " ", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(200)] + ["deadbeef" * 3 + " x "] * 2 + [("deadbeef" * 3 + " ") * 700, "see e8u86WLTuC9ER74B6nG197bw in internationalizationManager"]
    rows = {r.doc_id: r for r in secret_scan.secret_report(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = []
        for rank, (kind, p) in enumerate(BASE):
            for m in p.finditer(text):
                if kind == "assign" and len(m[2]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                    want.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        got = [s for s in rows[i].spans.split(",") if s and not s.startswith("markov")]
        assert got == [s for *_, s in sorted(want)], text
    assert rows[len(texts) - 1].spans == "markov:4:28"
    weights = secret_scan.train_locally()
    assert weights == secret_scan.train(spark)
    score = lambda p: sum(weights[ord(a) * 128 + ord(b)] for a, b in zip(p, p[1:], strict=False))
    sample = secret_scan.labelled_sample()
    assert sum((score(t) > secret_scan.PRIOR) == bool(k) for t, k in sample) > 0.99 * len(sample)


def test_statistics(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "#", "é", "\t", "!", "X"], k=rng.randrange(0, 60))) for _ in range(150)]
    rows = {r.doc_id: r for r in quality_rules.statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert want == tuple(rows[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_decision_list():
    rng = random.Random(1)
    rows = [({m: rng.randrange(100) for m in quality_rules.MEASURES}, 0) for _ in range(900)]
    rows = [(m, int(m["symbols"] > 80 or (m["upper"] > 60 and m["bangs"] > 70))) for m, _ in rows]
    rules = quality_rules.learn(rows)
    caught = [not quality_rules.decide(rules, m) for m, _ in rows]
    assert sum(c == bool(b) for c, (_, b) in zip(caught, rows, strict=True)) > 0.97 * len(rows)
    assert quality_rules.learn([(m, 0) for m, _ in rows]) == [] and quality_rules.verdict([]) == "true"


def test_the_order_of_a_decision_list_counts():
    rng = random.Random(2)
    rows = [{m: rng.randrange(100) for m in quality_rules.MEASURES} for _ in range(1200)]
    # long texts are good, whatever their symbols
    rows = [(m, int(m["words"] < 70 and m["symbols"] > 50)) for m in rows]
    rules = quality_rules.learn(rows)
    assert sum(quality_rules.decide(rules, m) != bool(bad) for m, bad in rows) > 0.97 * len(rows)
    first = [([("words", ">=", 70)], True), ([("symbols", ">=", 50)], False)]
    row = {**rows[0][0], "words": 80, "symbols": 90}
    assert quality_rules.decide(first, row) and not quality_rules.decide(first[::-1], row)
    assert quality_rules.verdict(first).startswith("CASE WHEN (n_words) >= 70 THEN true WHEN")


def test_verdicts_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.train(docs, labels)
    assert any(not keeps for _, keeps in rules)
    stats = {r.doc_id: r for r in quality_rules.statistics(docs).selectExpr("*", *(f"{e} AS m_{m}" for m, e in quality_rules.MEASURES.items())).collect()}
    rows = quality_rules.quality_report(docs, labels).collect()
    for r in rows:
        s = stats[r.doc_id]
        failed = s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words
        measures = {m: s[f"m_{m}"] for m in quality_rules.MEASURES}
        width = 10 * s.word_chars // max(s.n_words, 1)
        assert measures["width"] == width and measures["symbols"] == 1000 * s.n_symbols // max(s.word_chars, 1)
        assert (r.base_failed, r.kept) == (failed, not failed and quality_rules.decide(rules, measures))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    held = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in held) > 0.97 * len(held)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    score, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    bounds = np.array([0, 4, 5, 9])
    good, _ = quality_crf.forward_backward(score, bounds, trans)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total, mass = 0.0, np.zeros(b - a)
        for path in np.ndindex(*(2,) * (b - a)):
            p = np.exp(sum((s - 0.5) * score[a + i] for i, s in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += p
            mass += p * np.array(path)
        assert np.allclose(good[a:b], mass / total)


def test_stretches_of_long_texts_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 12))])
    for trans in (np.zeros((2, 2)), rng.normal(size=(2, 2))):
        score = rng.normal(size=bounds[-1]) * 4
        good, pairs = quality_crf.forward_backward(score, bounds, trans)
        for stretch in (1, 3, 8):
            monkeypatch.setattr(quality_crf, "STRETCH", stretch)
            p, q = quality_crf.forward_backward(score, bounds, trans)
            assert np.allclose(good, p, atol=1e-9) and np.allclose(pairs, q)
        monkeypatch.undo()
    start = time.perf_counter()
    assert len(quality_crf.forward_backward(rng.normal(size=1_000_000), np.array([0, 1_000_000]), np.eye(2))[0]) == 1_000_000
    assert time.perf_counter() - start < 30


def test_training_takes_a_bounded_number_of_lines(spark):
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:20]
    docs = spark.createDataFrame([(i, "good words in a line\n" * 30 if k % 2 else "### |||\n" * 30) for k, i in enumerate(free)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(free)], "doc_id long, quality int")
    assert quality_crf.train(docs, labels).constant is None
    # none fits, then one does: a model of a single class
    assert quality_crf.train(docs, labels, max_lines=20).constant == 1.0 and quality_crf.train(docs, labels, max_lines=40).constant in (0.0, 1.0)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = [r for r in quality_crf.quality_scores(docs, labels).join(labels, "doc_id").collect() if r.held_out]
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert all(r.predicted for r in rows if r.quality)


def test_training_on_an_id_of_many_rows(spark, monkeypatch):
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:12]
    docs = [(free[0], f"good words in a line {i} " * 20) for i in range(60)] + [(i, "### ||| !!! $$$ " * 20 + str(i)) for i in free[1:]]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i == free[0])) for i in free], "doc_id long, quality int")
    assert quality_crf.train(docs, labels, max_docs=20).constant is None
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda rows: seen.extend(bad for _, bad in rows) or [])
    monkeypatch.setattr(quality_rules, "base_failed", lambda: F.lit(False))
    quality_rules.train(docs, labels, max_docs=20)
    assert sorted(seen) == [0] + [1] * 11


def test_surrogates():
    m = pii.Surrogates("k")
    values = {tuple(m.permute("x", list(v), [3, 4, 2])) for v in np.ndindex(3, 4, 2)}
    assert len(values) == 24 and all(tuple(m.permute("x", list(v), [3, 4, 2])) != v for v in np.ndindex(3, 4, 2))
    text = "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (017) 555-7713 = +1 017-555-7713, card 4111 1111 1111 1111, 10.2.3.4, 123-45-6789. Dr. Anna Schmidt and Schmidt; Анна Иванова."
    found = [(k, text[a:b], m.replace(k, text[a:b])) for a, b, k in pii.find(text)]
    kinds = Counter(k.split(":")[0] for k, *_ in found)
    assert kinds == {"email": 2, "phone": 1, "card": 1, "ip": 1, "ssn": 1, "name": 5} or kinds["phone"] == 2
    by = {o: n for _, o, n in found}
    assert by["UND.34@MAIL7.EXAMPLE.COM"].lower() == by["und.34@mail7.example.com"] and by["Anna"] in pii.FIRST_NAMES["latin", "f"] and by["Анна"] in pii.FIRST_NAMES["cyrillic", "f"]
    card = [int(c) for c in by["4111 1111 1111 1111"] if c.isdigit()]
    assert card[-1] == pii._check_digit(card[:-1]) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", by["4111 1111 1111 1111"])
    assert all(n != o and len(re.findall(r"\W", n)) == len(re.findall(r"\W", o)) for _, o, n in found)
    # a name's part is the same wherever it stands, a number however it is written
    assert m.replace("name", "Anna") == by["Anna"] and pii.find("Dr. Anna")[0][2] == "name"
    assert m.replace("phone", "+1 (017) 555-7713").replace(" (", "").replace(") ", "").replace("-", "") == m.replace("phone", "+10175557713")
    assert [pii.country_code(p) for p in ("+1 (017)", "+4930 1", "+35312", "030 1")] == [2, 3, 4, 0]
    names = lambda t: [t[a:b] for a, b, k in pii.find(t) if k == "name"]
    assert names("Grace Hopper met Ahmed Hassan; Hopper left.") == ["Grace", "Hopper", "Ahmed", "Hassan", "Hopper"]
    assert names("Name: Zoltan Kovacs. my name is Nkechi Obi, Contact Bela Bartok <b.b@c.example.com>") == ["Zoltan", "Kovacs", "Nkechi", "Obi", "Contact", "Bela", "Bartok"]
    assert names("Ines Ines Ines Ines") == []
    assert names("In May the name was lost: Nothing here, The End of it (see below)") == []
    assert [k for *_, k in pii.find("4111 1111 1111 1111 and 4111 1111 1111 1112")] == ["card", "account"]
    assert pii.find("24be64439e3e49cf46b2d7c90f3602a3d0b907ff version 4.0. and 3.14") == []


def test_surrogates_in_a_corpus(spark):
    texts = [f"x{i}@mail.example.com and +1 (200) 555-{i:04d}" for i in range(50)] + ["x1@mail.example.com again", "clean text"]
    rows = {r.doc_id: r.text for r in pii.replace_entities(frame(spark, texts)).collect()}
    assert len({t.split(" ")[0] for t in rows.values()}) == 51 and rows[51] == "clean text"
    assert rows[50].split(" ")[0] == rows[1].split(" ")[0]
    assert pii.collisions(frame(spark, texts), "k").count() == 0


def test_surrogates_against_plain_python(spark):
    """Distinctness and coreference over a whole table, and nothing but entities changed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    first = ["Anna", "Grace", "Ahmed", "Иван"]
    extra = [f"{first[i % 4]} {chr(65 + i % 26)}orin{chr(97 + i % 17)}s wrote; Dr. {first[i % 4]}; +1 (200) 555-{i:04d}, +1200555{i:04d}, card {4000 + i} 1234 5678 9010" for i in range(120)]
    texts = [r.text for r in docs] + extra
    new = {r.doc_id: r.text for r in pii.replace_entities(frame(spark, texts).repartition(5)).collect()}
    maps = {}
    for i, text in enumerate(texts):
        at, out = 0, 0
        for a, b, kind in pii.find(text):
            gap = text[at:a]
            assert new[i][out : out + len(gap)] == gap
            out += len(gap)
            value = pii.normal(kind, text[a:b])
            was = maps.setdefault((kind, value), [])
            # the surrogate ends where what follows begins; its length is the original's but for listed first names
            length = len(text[a:b]) if value not in pii._LIST_OF or kind != "name" else len(re.match(pii._WORD, new[i][out:])[0])
            if kind == "ip":
                length = len(re.match(r"[\d.]+\d", new[i][out:])[0])
            was.append(pii.normal(kind, new[i][out : out + length]))
            out, at = out + length, b
        assert new[i][out:] == (text or "")[at:]
    assert all(len(set(s)) == 1 for s in maps.values()) and len(maps) > 200
    by = {(kind, s[0]) for (kind, _), s in maps.items()}
    assert len(by) == len(maps) and not any(s[0] == v for (_, v), s in maps.items())


def test_wrappers():
    assert fold(list("abab") + ["c", "c", "c"]) == [("+", ("a", "b")), ("+", ("c",))]
    once = lambda s: [(x, 0) for x in s]
    assert expression(align(once(["a", ("+", ("b", "c")), "d"]), once(["a", "b", "c", "x", "d"]))) == "a (b c)+ (x)? d"
    assert expression(align(once("abcd"), once("axyd"))) == "a (b c)? (x y)? d"
    long = [f"t{i}" for i in range(40)]
    assert fold(["x", *long * 3, "y"]) == ["x", ("+", tuple(long)), "y"]
    w = Wrapper()
    for n in (1, 3):
        w.add("<div><ul>" + "<li><a>x</a></li>" * 3 + "</ul>" + "<p>t</p>" * n + "</div>")
    assert expression(w.items) == "div ul (li a # /a /li)+ /ul (p # /p)+ /div"
    assert expression(Wrapper.load(w.dump()).items) == expression(w.items) and w.links() == {"li"}
    assert read("<p>a<p>b")[0] == ["p", "#", "p", "#"]


def test_long_pages_are_aligned():
    a, b = [f"a{i}" for i in range(3000)], [f"a{i}" for i in range(3000)]
    b[1000:1500] = [f"b{i}" for i in range(700)]
    merged = align([(x, 0) for x in a], [(x, 0) for x in b])
    assert len(merged) == 3700 and [x for x, o in merged if not o] == a[:1000] + a[1500:]
    page = "".join(f"<p class='k{i}'>text {i}</p>" for i in range(6000))
    w = Wrapper()
    w.add(page)
    w.add(page + "<div>more</div>")
    assert len(w.items) >= 18_000 and w.items[-1][1] and main_text(page, w.boilerplate()).count("\n") == 5999


def test_wrapper_alone_finds_the_text(spark, monkeypatch):
    """Without main elements and class words the wrapper still tells the text of pages from what stands around it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = [main_text(p.html) for p in pages]
    monkeypatch.setattr(html_extract, "NOISE", frozenset())
    bare = [re.sub("</?article>", "", p.html or "") for p in pages]
    wrappers: dict[str, Wrapper] = {}
    hosts = [re.sub(r"^https?://([^/]*).*", r"\1", p.url or "") for p in pages]
    for name, page in zip(hosts, bare, strict=True):
        wrappers.setdefault(name, Wrapper()).add(page)
    ruled = {name: w.boilerplate() for name, w in wrappers.items()}
    right = sum(main_text(page, ruled[name]) == text for name, page, text in zip(hosts, bare, want, strict=True))
    off = sum(main_text(page) == text for page, text in zip(bare, want, strict=True))
    assert right >= 0.9 * len(pages) and off <= 0.1 * len(pages), (right, off)


def test_no_page_is_left_out_of_a_long_wrapper(monkeypatch):
    monkeypatch.setattr("maskwright.llm.html_extract.MOST_ITEMS", 40)
    menu = "<div><ul>" + "<li><a>x</a></li>" * 3 + "</ul></div>"
    long = "".join(f"<p class='c{i}'>t</p>" for i in range(20))
    one, two = Wrapper(), Wrapper()
    one.add(long)  # 60 items
    one.add("".join(f"<p class='d{i}'>t</p>" for i in range(12)))
    two.add("".join(f"<p class='e{i}'>t</p>" for i in range(13)) + menu)
    two.add(long + menu.replace("li", "dd"))
    for a, b in ((one, two), (two, one)):
        merged = Wrapper.load(a.dump())
        merged.merge(Wrapper.load(b.dump()))
        assert merged.links() == {"li", "dd"} and "div ul li a" in merged.boilerplate()


def test_classes_of_whole_pages():
    for page in ('<body class="has-sidebar"><p>x</p></body>', '<html class="no-banner"><p>x</p>', '<article class="post comments-open"><p>x</p><div class="comments">y</div></article>', '<main id="search"><p>x</p></main>'):
        assert main_text(page) == "x"
    assert main_text("<article hidden><p>x</p></article>") == main_text('<div class="banner">x</div>') == ""


@pytest.mark.parametrize("page", ["<", "<a href='x>y", "<script>never closed <p>", "<!-- open <p>x", "a < b > c", "</p></p><p", "<p a=\"1\" b='2>3'>x</p>"])
def test_broken_pages(page):
    read(page)


def test_places_of_the_wrapper_choose_content(monkeypatch):
    """A constant block of the same path as the text is told by its place in the aligned expression; alike pages keep what they share."""
    same = "<p>Read more in our weekly letter.</p>"
    page = lambda n, k: f"<body><article><h1>t{n}</h1>" + "".join(f"<p>text {n} {i} of some length, as texts have it that go on for a line or two more</p>" for i in range(k)) + f"<ul><li>a{n}</li></ul>{same}</article>"
    pages = [page(n, 1 + n % 3) for n in range(8)] + [page(8, 2).replace(same, "")]
    one, two = Wrapper(), Wrapper()
    for n, p in enumerate(pages):
        (one, two)[n % 2].add(p)
    merged = Wrapper.load(one.dump())
    merged.merge(Wrapper.load(two.dump()))
    assert "weekly" in main_text(pages[0], merged.boilerplate())  # its path alone does not tell it
    texts = [main_text(p, *html_extract._ruling(merged.dump())) for p in pages]
    assert texts == [main_text(p.replace(same, "")) for p in pages]
    # a page that has other text at that place keeps it
    other = pages[1].replace("Read more in our weekly letter.", "The end of the story.")
    assert main_text(other, *html_extract._ruling(merged.dump())).endswith("The end of the story.")
    # without alignment there are no places
    monkeypatch.setattr(html_extract, "align_places", lambda a, b: (a, [(k, 0) for k in range(len(a))], [(-1, 0)] * len(b)))
    assert "weekly" in main_text(pages[0], *html_extract._ruling(merged.dump()))
    monkeypatch.undo()
    near = Wrapper()
    body = "<body><article>" + "".join(f"<p>long paragraph {i} that all copies share</p><hr>" for i in range(9))
    for n in range(6):
        near.add(f"{body}<h2>edit {n}</h2>")
    assert not near.fixed()


def test_places_follow_alignments():
    """Marks stay with their tokens through folding and alignment."""
    for a, b in (("xa#yb#", "xa#a#a#zb#"), ("#", "a#a#"), ("p#qp#q", "p#qrp#q"), ("abc", "#x#")):
        folded = [html_extract.fold_places(list(s)) for s in (a, b)]
        merged, *where = align(*[[(x, 0) for x in f[0]] for f in folded]), *html_extract.align_places(*[[(x, 0) for x in f[0]] for f in folded])[1:]
        flat = [list(html_extract._flat(x)) for x, _ in merged]
        for text, (_, places), to in zip((a, b), folded, where, strict=True):
            seen = [t for k, f in enumerate(places) for at, ts in enumerate(f) for t in ts if flat[to[k][0]][to[k][1] + at] == text[t]]
            assert sorted(seen) == list(range(len(text)))
