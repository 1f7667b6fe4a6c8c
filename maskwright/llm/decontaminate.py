"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` splits the documents into segments.  A segment is one stored
row: a sorted term dictionary, and for each term the places where it occurs,
counted through all documents of the segment with a gap between documents.
``term_counts`` sums the dictionaries' counts for the terms of the test items.
``phrase_search`` takes each test window's terms from the rarest to the most
frequent, subtracts each term's place in the window from its postings and
intersects the lists; what remains are the exact occurrences.  Terms are known
by 64-bit hashes: equal hashes of a whole window stand for equal words.
``proximity_search`` keeps the places where all terms occur within a span.

The index is split by document, so a word, a source or a passage that a third
of all rows share is spread over all segments, and no shuffle is needed.  The
test items are cut into pieces of at most ``piece_words`` words, overlapping by a
window less a word, so no item is too long, and travel to the segments in
blocks of about ``block_chars`` characters.  One block at a time is on the driver and
broadcast; its result is written before the next one starts, so neither grows
with the benchmark.

Ids of documents may be of any type and are kept.  Null and empty texts have no words: they are never contaminated, and as test
items they have no windows.  Test items without an id mark words but are not
listed.  Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import keep, released, small_batches, write
from .tokens import Words, groups

WINDOW = 13
SEGMENT_WORDS = 1 << 20
BLOCK_CHARS = 2 << 20
#: Places left free between documents; no phrase or proximity span may be longer.
GAP = 256

#: Documents of a segment, so that places and gaps fit into 32 bits.
SEGMENT_DOCS = 1 << 16
PIECE_WORDS = 1 << 16


def _index_type(ids: T.DataType) -> T.StructType:
    blobs = [T.StructField(c, T.BinaryType()) for c in ("doc_words", "terms", "counts", "postings")]
    return T.StructType([T.StructField("segment", T.LongType()), T.StructField("doc_ids", T.ArrayType(ids)), *blobs])


def _segment(number: int, ids: list[pa.Array], counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    words, flat = np.concatenate(counts).astype(np.int32), np.concatenate(hashes)
    gaps = np.repeat(np.arange(len(words), dtype=np.int32) * GAP, words)
    places = np.arange(len(flat), dtype=np.int32) + gaps
    order = np.argsort(flat, kind="stable")
    terms, first = np.unique(flat[order], return_index=True)
    sizes = np.diff(np.append(first, len(flat))).astype(np.int32)
    listed = pa.concat_arrays(ids)
    row = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), *(pa.array([x.tobytes()], pa.binary()) for x in (words, terms, sizes, places[order]))]
    return pa.record_batch(row, ["segment", "doc_ids", "doc_words", "terms", "counts", "postings"])


def _index_rows(segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = docs = 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups([len(t or "") for t in texts]):
                w = Words(texts[a:b])
                ids.append(keys.slice(a, b - a))
                counts.append(w.counts)
                hashes.append(w.hashes)
                held += len(w.hashes)
                docs += b - a
                if held >= segment_words or docs >= SEGMENT_DOCS:
                    yield _segment(number, ids, counts, hashes)
                    number, ids, counts, hashes, held, docs = number + 1, [], [], [], 0, 0
        if ids:
            yield _segment(number, ids, counts, hashes)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of all ``docs``, whole texts."""
    small_batches(docs.sparkSession)
    return keep(docs.select(id_col, "text").mapInArrow(released(_index_rows(segment_words)), _index_type(docs.schema[id_col].dataType)), "positional-index")


class Windows:
    """The windows of a block of test items as rows of term hashes."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.items = [i for i, _ in items]
        w = Words([t for _, t in items])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, n in enumerate(w.counts):
            if n:
                length = int(min(n, size))
                own = w.hashes[w.bounds[k] : w.bounds[k + 1]]
                rows = np.lib.stride_tricks.sliding_window_view(own, length)
                found.setdefault(length, []).append((rows, np.full(len(rows), k)))
        for length, parts in found.items():
            self.by_length[length] = (np.concatenate([p for p, _ in parts]), np.concatenate([k for _, k in parts]))
        self.terms = np.unique(w.hashes)


def _lookup(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted term in the sorted dictionary, or -1."""
    if not len(terms):
        return np.full(wanted.shape, -1)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of ``terms`` (bounded by a block of test items) occurs in the corpus."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _lookup(np.frombuffer(t, np.uint64), sent.value)
                total += np.where(at >= 0, np.frombuffer(c, np.int32)[at] if c else 0, 0)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[term] = n
    sent.destroy()
    return out


class Segment:
    """One stored row, ready for searches."""

    def __init__(self, doc_words: bytes, terms: bytes, counts: bytes, postings: bytes):
        self.words = np.frombuffer(doc_words, np.int32).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.words + GAP)])
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])
        self.postings = np.frombuffer(postings, np.int32)

    def places(self, term: int) -> np.ndarray:
        return self.postings[self.ends[term] : self.ends[term + 1]]

    def phrase(self, terms: np.ndarray, rarest: np.ndarray) -> np.ndarray:
        """Starts of the exact phrase; ``rarest``: its positions, rarest term first."""
        starts = self.places(terms[rarest[0]]) - np.int32(rarest[0])
        for j in rarest[1:]:
            if not len(starts):
                break
            listed = self.places(terms[j])
            at = np.minimum(np.searchsorted(listed, starts + np.int32(j)), len(listed) - 1)
            starts = starts[listed[at] == starts + np.int32(j)]
        return starts

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Places of the rarest term with all others fewer than ``span`` (at most GAP) places away."""
        lists = sorted((self.places(t) for t in set(terms.tolist())), key=len)
        found = lists[0]
        for listed in lists[1:]:
            at = np.searchsorted(listed, found)
            left, right = listed[np.maximum(at - 1, 0)], listed[np.minimum(at, len(listed) - 1)]
            found = found[(np.abs(left - found) < span) | (np.abs(right - found) < span)]
        return found


_HITS = ["doc_id", "n_words", "starts", "ends", "items"]


def _verdicts(index: DataFrame) -> str:
    return f"doc_id {_ids(index)}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _ids(index: DataFrame) -> str:
    return index.schema["doc_ids"].dataType.elementType.simpleString()


def phrase_search(index: DataFrame, items: list[tuple[str | None, str | None]], size: int = WINDOW) -> DataFrame:
    """Per document: the merged word ranges inside any window, and the items (a bounded list) found there."""
    return _search(index, items, size)[0]


def _search(index: DataFrame, items: list[tuple[str | None, str | None]], size: int, summed: bool = False) -> tuple[DataFrame, Broadcast]:
    """The result and what it has broadcast; ``summed``: with the verdicts, in the same pass."""
    windows = Windows(items, size)
    frequency = term_counts(index, windows.terms)
    ranks = {n: np.argsort(frequency[_lookup(windows.terms, rows)], axis=1, kind="stable").astype(np.int32) for n, (rows, _) in windows.by_length.items()}
    sent = index.sparkSession.sparkContext.broadcast((windows, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, ranks = sent.value
        names = np.array([i if i is not None else "" for i in windows.items], object)
        for batch in batches:
            for row in range(batch.num_rows):
                number, doc_ids = batch.column(0)[row].as_py(), batch.column(1)[row].values
                seg = Segment(*(c[row].as_py() for c in batch.columns[2:]))
                change = np.zeros(seg.base[-1] + 1, np.int32)
                pairs: list[np.ndarray] = []
                for length, (rows, owner) in windows.by_length.items():
                    local = _lookup(seg.terms, rows)
                    for k in np.flatnonzero((local >= 0).all(axis=1)):
                        starts = seg.phrase(local[k], ranks[length][k])
                        if len(starts):
                            change[starts] += 1
                            change[starts + length] -= 1
                            docs = np.unique(np.searchsorted(seg.base, starts, "right") - 1)
                            pairs.append(np.stack([docs, np.full(len(docs), owner[k])], 1))
                mask = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=np.int8(0))
                starts, ends = np.flatnonzero(mask == 1), np.flatnonzero(mask == -1)
                doc_of = np.searchsorted(seg.base, starts, "right") - 1
                cuts = np.searchsorted(doc_of, np.arange(len(seg.words) + 1))
                starts, ends = starts - seg.base[doc_of], ends - seg.base[doc_of]
                listed: dict[int, set] = {}
                for d, i in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
                    if windows.items[i] is not None:
                        listed.setdefault(d, set()).add(names[i])
                n = len(seg.words)
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), doc_ids, pa.array(seg.words),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(starts.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ends.astype(np.int32))),
                        pa.array([sorted(listed.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    ],
                    ["segment", "doc_no", "doc_id", "n_words", "starts", "ends", "items"],
                )

    found = f"segment long, doc_no int, doc_id {_ids(index)}, n_words long, starts array<int>, ends array<int>, items array<string>"
    rows = index.select("segment", "doc_ids", "doc_words", "terms", "counts", "postings")
    if summed:  # a second operator would be a second worker for each task
        return rows.mapInArrow(released(lambda batches: _summary(b.select(_HITS) for b in run(batches))), _verdicts(index)), sent
    return rows.mapInArrow(released(run), found), sent


def proximity_search(index: DataFrame, phrases: list[str], span: int) -> DataFrame:
    """Documents where all words of a phrase (a bounded list of them) occur within ``span`` words of its rarest word."""
    if not 0 < span <= GAP:
        raise ValueError(f"span must be 1 to {GAP}")
    w = Words(phrases)
    sent = index.sparkSession.sparkContext.broadcast([w.hashes[w.bounds[k] : w.bounds[k + 1]] for k in range(len(phrases))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column(1)[row].values
                seg = Segment(*(c[row].as_py() for c in batch.columns[2:]))
                docs, phrase, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                for k, terms in enumerate(sent.value):
                    local = _lookup(seg.terms, terms)
                    if len(local) and (local >= 0).all():
                        places = seg.near(local, span)
                        docs.append(np.searchsorted(seg.base, places, "right") - 1)
                        phrase.append(np.full(len(places), k, np.int32))
                        place.append((places - seg.base[docs[-1]]).astype(np.int32))
                yield pa.record_batch([doc_ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(phrase)), pa.array(np.concatenate(place))], ["doc_id", "phrase", "place"])

    return index.select("segment", "doc_ids", "doc_words", "terms", "counts", "postings").mapInArrow(run, f"doc_id {_ids(index)}, phrase int, place int")


def _pieces(size: int, piece_words: int):
    """Items in pieces that have every window of ``size`` words once; shorter items stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) <= piece_words:
                    items.append(item)
                    texts.append(text)
                    continue
                w = Words([text])
                for at in range(0, max(len(w.hashes) - size + 1, 1), piece_words):
                    own = slice(at, at + piece_words + size - 1)
                    items.append(item)
                    texts.append(bytes(w.data[w.starts[own][0] : w.ends[own][-1]]).decode("utf-8", "surrogatepass") if len(w.hashes) else "")
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return run


def _blocks(benchmark: DataFrame, block_chars: int, size: int = WINDOW, piece_words: int = PIECE_WORDS) -> Iterator[list[tuple[str | None, str | None]]]:
    """Blocks of (item, text); the driver holds one, and at most one partition's pieces."""
    block: list[tuple[str | None, str | None]] = []
    held = 0
    pieces = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_pieces(size, piece_words), "item string, text string")
    for item, text in pieces.toLocalIterator():
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, starts, ends, items = (batch.column(i).to_pylist() for i in range(1, 5))
        hits, names = [], []
        for s, e, i in zip(starts, ends, items, strict=True):
            n, reach = 0, 0
            for a, b in sorted(zip(s, e, strict=True)):
                n += max(b, reach) - max(a, reach)
                reach = max(b, reach)
            hits.append(n)
            names.append(sorted(set(i)))
        yield pa.record_batch(
            [
                batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                pa.array([h > 0 and 20 * h >= w for h, w in zip(hits, words, strict=True)], pa.bool_()), pa.array(names, pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", size: int = WINDOW, block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Per document: words, words inside windows of ``benchmark``, items found, and the verdict (a twentieth of the words hit)."""
    index = build_index(docs, id_col)
    blocks = _blocks(benchmark, block_chars, size, piece_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _search(index, first, size, summed=True)[0]
    hits = []
    for block in chain([second], blocks):
        part, sent = _search(index, block, size)
        hits.append(write(part.filter(F.size("starts") > 0), "phrase-hits"))
        sent.destroy()
    found, _ = _search(index, first, size)
    rest = docs.sparkSession.read.schema(found.schema).parquet(*hits)
    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")}
    found = found.unionByName(rest).groupBy("segment", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists.values())
    return found.select(_HITS).mapInArrow(_summary, _verdicts(index))
