"""Best-fit packing of tokenised documents by hierarchical residual packing.

One pass tokenises whole texts and packs each partition's pieces locally, the
longest first, each into the open bin it fits best.  Bins with at most ``slack``
free places are final.  The rest become items themselves: rounds deal them to
groups of about ``group_bins``, merge each group by best fit, and pass on what
is still underfull, until one group holds all or a round saves less than
``least_gain`` of the bins it got.  That parameter decides when to stop looking for fuller
bins only: every piece is in a sequence after any round.  Bins of a group that
are left are more than half full but for one, so later rounds gain little.
A task never holds more than a partition's lengths or a few groups of bins.

Only documents of more than ``capacity`` tokens are cut; their pieces are full
but for the first.  Ids come from the vocabulary file at ``tokenizer_path``
(a documented parameter), and every document ends with ``end_id``.  A null text
counts as empty and is packed as its end id alone; repeated rows are packed
once each; columns other than the id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, released, small_batches

CAPACITY = 1024
END_ID = 2
SLACK = 8
GROUP_BINS = 4096
LEAST_GAIN = 0.001
TOKENIZER = "byte_bpe_50k.json"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, fill int, offset long"
_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of the tokenizer file; a rank-based encoder of the same vocabulary serves ordinary texts faster."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.quick = None
        if path.endswith(TOKENIZER):
            import public_tokenizers
            import tiktoken

            with open(path.replace(".json", ".tiktoken"), "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        # Texts with the look of special tokens, and huge ones, take the exact path.
        if self.quick is None or "<|" in text or len(text) > 1_000_000:
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: full from the end, the first takes what is left."""
    first = length % capacity or capacity
    return [(0, first), *((s, s + capacity) for s in range(first, length, capacity))]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    have = 0  # a bit for each number of free places that some bin has
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = have >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                have &= ~(1 << free)
            offsets[i] = fills[b]
            fills[b] += n
        else:
            free, b = capacity, len(fills)
            fills.append(n)
        bins[i] = b
        if left := free - n:
            open_bins[left].append(b)
            have |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _pack_partition(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        columns: list[list] = [[], [], [], [], []]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*enc.ids(text.as_py() or ""), end_id], "<u4")
                for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                    for column, v in zip(columns, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(v)
        n = len(columns[0])
        if not n:
            return
        bins, offsets, fills = best_fit(np.array(columns[3], np.int64), capacity)
        first = TaskContext.get().partitionId() << 36
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        arrays += [pa.array(bins + first), pa.array(fills[bins].astype(np.int32)), pa.array(offsets)]
        table = pa.table(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "fill", "offset"])
        yield from table.to_batches(max_chunksize=50_000)

    return run


def _merge_groups(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.concat_tables(parts).sort_by([("part", "ascending"), ("bin", "ascending")])
        part, item, fill = (rows.column(c).to_numpy() for c in ("part", "bin", "fill"))
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])), strict=True):
            bins, shifts, fills = best_fit(fill[a:b].astype(np.int64), capacity)
            leader = np.zeros(len(fills), np.int64)
            leader[bins[shifts == 0]] = item[a:b][shifts == 0]
            yield pa.record_batch([pa.array(item[a:b]), pa.array(leader[bins]), pa.array(shifts), pa.array(fills[bins].astype(np.int32))], ["bin", "into", "shift", "fill"])

    return run


def merge_bins(items: DataFrame, capacity: int, slack: int, group_bins: int, least_gain: float = LEAST_GAIN) -> DataFrame | None:
    """Where each underfull bin of ``items`` (bin, fill) goes: (bin, into, shift); None if there is none."""
    where = None
    n, turn = items.count(), 0
    while n:
        groups = -(-n // group_bins)
        dealt = items.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups))).repartition(groups, "part")
        step = keep(dealt.mapInArrow(_merge_groups(capacity), "bin long, into long, shift long, fill int"), "packing-round")
        if where is None:
            where = step.select("bin", "into", "shift")
        else:
            on = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            where = keep(where.join(on, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "packing-map")
        items = step.filter((F.col("bin") == F.col("into")) & (F.col("fill") < capacity - slack)).select("bin", "fill")
        left = items.count()
        if groups == 1 or left > (1 - least_gain) * n:
            break
        n, turn = left, turn + 1
    return where


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, group_bins: int = GROUP_BINS, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_pack_partition(tokenizer_path or default_tokenizer(), capacity, end_id)), _PIECES)
    pieces = keep(rows, "packing-pieces")
    # the item at offset 0 stands for its bin
    items = pieces.filter((F.col("fill") < capacity - slack) & (F.col("offset") == 0)).select("bin", "fill")
    where = merge_bins(items, capacity, slack, group_bins, least_gain)
    out = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    if where is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(where, "bin", "left").select(*out, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
