"""Similarity join of documents on the Jaccard index of their word n-grams.

Texts with the same n-gram set form a class, found by a 128-bit digest of the
sorted set; one row stands for each class from there on.  MinHash signatures
are cut into bands whose number and rows are chosen for the target recall at
the threshold.  Classes that share a band's hash meet in a bucket.

Buckets of at most ``LARGE`` classes are verified pair by pair in one task
each, a pair in the first band that it shares.  Classes that meet in larger
buckets form families, connected through one hub a bucket.  A class of a
family is written as its difference from the family's first set, the core:
``|a & b| = |a & core| + |b & core| - |core| + |da & db|`` for the differences
da and db.  Parts of differences that no second class of the family has cannot
count and go, and so do classes whose remaining parts are too few for a link to
any other.  What is left is packed into blocks of at most ``BLOCK`` classes, one
row each; pairs of blocks whose bounds allow a link go to tasks of bounded size.
So every class is one row of a family, not one for each bucket or pair; links
come as a row per class and block pair (number, smallest, root of a spanning
forest), never as pairs; and no bucket is capped, no link lost.

Result, one row per input row: ``doc_id``; ``class_id``, the smallest id of the
class; ``n_copies``, the documents of the class; ``n_links``, the documents of
other classes at or above the threshold; ``link_id``, the smallest of their
class ids, or null; ``group_id``, the smallest id of all documents connected by
links.  A text of fewer words than an n-gram has one n-gram, all its words.
Texts without words (null, empty, blank) are linked to nothing and each is its
own class.  Repeated rows are copies; null ids are allowed and never smallest.
Ids are whole numbers, strings or binary; others are taken as strings.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import hashed_side, keep, released, small_batches
from .tokens import Words, groups, mix, stream

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.99999
MAX_HASHES = 128
#: Most classes of a bucket that is verified pair by pair, and most n-grams of one with more than two classes.
LARGE, LARGE_GRAMS = 128, 1 << 20
#: Most classes of a family's block, and about how many parts of differences.
BLOCK, BLOCK_PARTS = 1024, 1 << 18
#: Cores of families are broadcast up to this many bytes, else joined.
BROADCAST_BYTES = 32 << 20


def choose_bands(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as possible with the recall reached at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands within max_hashes reach the recall")
    return best


def set_of(grams: np.ndarray) -> np.ndarray:
    return np.unique(grams)


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        a, b = stream(1, k) | np.uint64(1), stream(2, k)
        weights = stream(3, rows) | np.uint64(1)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in groups([len(t or "") for t in texts]):
                grams, bounds = Words(texts[lo:hi]).shingles(size)
                some = np.flatnonzero(np.diff(bounds))
                signature = np.zeros((hi - lo, bands), np.uint64)
                with np.errstate(over="ignore"):
                    if len(some):
                        for i in range(k):
                            low = np.minimum.reduceat((grams * a[i] + b[i]) >> np.uint64(32), bounds[:-1][some])
                            signature[some, i // rows] += (low + np.uint64(1)) * weights[i % rows]
                    signature = mix(signature)
                sets = [set_of(grams[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                cut = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands)
                yield pa.record_batch(
                    [keys.slice(lo, hi - lo), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(cut, pa.array(signature.view(np.int64).ravel()))],
                    ["doc_id", "cls", "n", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in groups([len(t or "") for t in texts]):
                grams, bounds = Words(texts[lo:hi]).shingles(size)
                sets = [set_of(grams[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "grams"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive rows with equal ``keys``, as many groups as a batch completes."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        if rest and any(rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        last = np.flatnonzero(change)
        if len(last):
            yield pa.Table.from_batches([*rest, batch.slice(0, int(last[-1]))])
            rest = [batch.slice(int(last[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


_KEYS = ["band", "h"]


def _cut(table: pa.Table) -> np.ndarray:
    """Bounds of the groups of a table of whole groups."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in _KEYS:
        column = table.column(key).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _bands_of(table: pa.Table) -> np.ndarray:
    column = table.column("bands").combine_chunks()
    return column.flatten().to_numpy().reshape(table.num_rows, -1)


def _families_of(table: pa.Table) -> np.ndarray:
    """A number for each family; classes without one get one each."""
    found = table.column("family").combine_chunks().dictionary_encode().indices
    alone = -1 - np.arange(table.num_rows)
    return np.where(found.is_null().to_numpy(zero_copy_only=False), alone, found.fill_null(0).to_numpy())


def _first_shared(bands: np.ndarray, family: np.ndarray, band: int) -> np.ndarray:
    """Pairs (i < j) of different families whose first shared band is ``band``."""
    new = np.triu(family[:, None] != family[None, :], 1)
    for k in range(band):
        new &= bands[:, None, k] != bands[None, :, k]
    return new


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the members of a bucket that have a pair first met in its band."""
    for table in _runs(batches, _KEYS):
        cut, bands, family, band = _cut(table), _bands_of(table), _families_of(table), table.column("band").to_numpy()
        wanted = np.zeros(table.num_rows, bool)
        sizes = np.diff(cut)
        two = cut[:-1][sizes == 2]
        if len(two):  # most buckets hold two classes
            new = ((bands[two] == bands[two + 1]).argmax(1) == band[two]) & (family[two] != family[two + 1])
            wanted[two[new]] = wanted[two[new] + 1] = True
        for g in np.flatnonzero(sizes > 2):
            a, b = cut[g], cut[g + 1]
            pairs = _first_shared(bands[a:b], family[a:b], band[a])
            wanted[a:b] = pairs.any(0) | pairs.any(1)
        yield from table.select(["band", "h", "cls"]).filter(pa.array(wanted)).to_batches()


def overlap(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets, where ``wanted``."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if wanted.sum() <= 3:
        for i, j in zip(*np.nonzero(wanted), strict=True):
            both = np.sort(np.concatenate([sets[i], sets[j]]))
            out[i, j] = (both[1:] == both[:-1]).sum()
        return out
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, len(names), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        dense = np.zeros((n, 4096), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += (dense @ dense.T).astype(np.int64)
    return out


#: Types of ids as they travel, and what stands for a missing one beside a mark; ids of other types travel as strings.
_IDS = {"bigint": (pa.int64(), 0), "binary": (pa.binary(), b""), "string": (pa.string(), "")}
_WHOLE = frozenset(("tinyint", "smallint", "int", "bigint"))


def _links(ids: str) -> str:
    return f"cls binary, links long, low {ids}, id {ids}, root_id {ids}, root_cls binary"


def _link_rows(linked: np.ndarray, cls: list, ids: list, copies: np.ndarray) -> list[tuple]:
    """A row for each class with links, of a symmetric matrix; its root is the first that it is connected to."""
    root = np.arange(len(linked))
    while True:
        reach = np.where(linked, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, reach)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = []
    for i in np.flatnonzero(linked.any(1)):
        others = np.flatnonzero(linked[i])
        low = min((v for v in (ids[j] for j in others) if v is not None), default=None)
        out.append((cls[i], int(copies[others].sum()), low, ids[i], ids[root[i]], cls[root[i]]))
    return out


def _batch(rows: list[tuple], ids: str) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), *(_IDS[ids][0],) * 3, pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["cls", "links", "low", "id", "root_id", "root_cls"])


def _verify(threshold: float, kind: str):
    """Links of the pairs that a bucket's band is the first to show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, _KEYS):
            cut, bands, family = _cut(table), _bands_of(table), _families_of(table)
            band, copies, size = (table.column(c).to_numpy() for c in ("band", "copies", "n"))
            ids, cls, blob = (table.column(c).to_pylist() for c in ("class_id", "cls", "grams"))
            out: list[tuple] = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                pairs = _first_shared(bands[a:b], family[a:b], band[a])
                pairs &= np.minimum.outer(size[a:b], size[a:b]) >= threshold * np.maximum.outer(size[a:b], size[a:b]) - 1e-9
                if not pairs.any():
                    continue
                used = np.flatnonzero(pairs.any(0) | pairs.any(1))
                pairs = pairs[np.ix_(used, used)]
                n = size[a:b][used].astype(np.int64)
                inter = overlap([np.frombuffer(blob[a + i], np.uint64) for i in used], pairs)
                linked = pairs & (inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9)
                out += _link_rows(linked | linked.T, [cls[a + i] for i in used], [ids[a + i] for i in used], copies[a:b][used])
            if out:
                yield _batch(out, kind)

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """family, cls, n-grams shared with the family's core, n-grams of the core, and what only one of both has."""
    for batch in batches:
        family, cls, grams, core = (batch.column(c) for c in ("family", "cls", "grams", "core"))
        rows = []
        for i in range(batch.num_rows):
            own, base = (np.frombuffer(x[i].as_py(), np.uint64) for x in (grams, core))
            parts = np.setxor1d(own, base, assume_unique=True)
            rows.append(((len(own) + len(base) - len(parts)) // 2, len(base), parts.view(np.int64)))
        cut = np.concatenate([[0], np.cumsum([len(p) for *_, p in rows])]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(p for *_, p in rows)]))
        yield pa.record_batch(
            [family, cls, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(cut), flat)],
            ["family", "cls", "same", "core", "parts"],
        )


def _verify_blocks(threshold: float, kind: str):
    """Links between two blocks of a family, or inside one; a row holds both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                core, first, second = (batch.column(c)[row].as_py() for c in ("core", "first", "second"))
                members = first + (second or [])
                side = np.repeat([0, 1], [len(first), len(second or [])])
                n, same = (np.array([m[k] for m in members], np.int64) for k in ("n", "same"))
                wanted = np.triu(np.ones((len(n), len(n)), bool), 1)
                if second:
                    wanted &= side[:, None] != side[None, :]
                inter = same[:, None] + same[None, :] - core + overlap([np.array(m["parts"], np.int64).view(np.uint64) for m in members], wanted)
                linked = wanted & (inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9)
                rows = _link_rows(linked | linked.T, [m["cls"] for m in members], [m["class_id"] for m in members], np.array([m["copies"] for m in members], np.int64))
                if rows:
                    yield _batch(rows, kind)

    return run


def family_links(classes: DataFrame, families: DataFrame, sets: DataFrame, threshold: float, ids: str) -> DataFrame:
    """Links inside ``families`` (cls, family) from the n-gram sets (cls, grams) of their classes."""
    roots = families.select(F.col("family").alias("cls")).distinct()
    size = roots.join(classes, "cls").agg(F.sum("n")).first()[0] or 0
    cores = sets.join(roots, "cls").select(F.col("cls").alias("family"), F.col("grams").alias("core"))
    members = sets.join(families, "cls").join(F.broadcast(cores) if 8 * size <= BROADCAST_BYTES else cores, "family")
    told = keep(members.select("family", "cls", "grams", "core").mapInArrow(released(_differences), "family binary, cls binary, same int, core int, parts array<long>"), "differences")
    # a part that one class alone has is in no intersection
    parts = told.select("family", "cls", F.explode("parts").alias("part"))
    common = parts.groupBy("family", "part").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    shared = parts.join(common, ["family", "part"]).groupBy("cls").agg(F.collect_list("part").alias("parts"))
    rows = told.drop("parts").join(shared, "cls", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<long>"))).join(classes.drop("bands"), "cls")
    # (1 + t) |a & b| >= t (|a| + |b|) is, with ``worth`` of each side: worth + worth + (1 + t) |da & db| >= (1 + t) |core|
    rows = keep(rows.withColumn("worth", (1 + threshold) * F.col("same") - threshold * F.col("n")).withColumn("p", F.size("parts")), "family-classes")
    steps = [k / 32 for k in range(1, 32)]
    tops = rows.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("p").alias("all"), F.max("worth").alias("top"), F.percentile_approx("worth", steps, 1000).alias("cuts"))
    rows = rows.join(hashed_side(keep(tops, "family-bounds"), 600), "family").filter(F.col("worth") + F.col("top") + (1 + threshold) * F.col("p") >= (1 + threshold) * F.col("core") - 1e-6)
    groups = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / BLOCK_PARTS))
    # by worth, as far as 32 ranges reach, so that bounds tell blocks apart; then by hash
    range_ = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("worth"))) * F.least(groups, F.lit(32)) / 32)
    rows = rows.withColumn("block", (range_ + 32 * F.pmod(F.xxhash64("cls"), F.ceil(groups / 32))).cast("long"))
    # dealt by block: a family's rows must not stay together
    packed = rows.repartition("family", "block").groupBy("family", "block").agg(
        F.first("core").alias("core"), F.max("worth").alias("most"), F.max("p").alias("p"), F.collect_list(F.struct("cls", "class_id", "copies", "n", "same", "parts")).alias("members")
    )
    packed = keep(packed, "family-blocks")
    bound = lambda x, y: F.col(f"{x}.most") + F.col(f"{y}.most") + (1 + threshold) * F.least(f"{x}.p", f"{y}.p") >= (1 + threshold) * F.col(f"{x}.core") - 1e-6
    ends = packed.drop("members")
    met = ends.alias("x").join(ends.alias("y"), (F.col("x.family") == F.col("y.family")) & (F.col("x.block") < F.col("y.block")) & bound("x", "y"))
    met = met.select(F.col("x.family").alias("family"), F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    firsts = packed.select("family", "block", "core", F.col("members").alias("first"))
    seconds = packed.select("family", F.col("block").alias("other"), F.col("members").alias("second"))
    across = firsts.join(met, ["family", "block"]).join(seconds, ["family", "other"]).select("core", "first", "second")
    inside = firsts.select("core", "first", F.lit(None).cast(seconds.schema["second"].dataType).alias("second"))
    return inside.unionByName(across).mapInArrow(released(_verify_blocks(threshold, ids)), _links(ids))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "cls")


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of every vertex of ``edges`` (cls, root), any kind that has an order: root becomes the smallest connected one.

    Labels are the smallest among a vertex, its neighbours and their labels'
    labels; every round is written, so the lineage stays short.  Rounds are about
    the logarithm of the longest path, as labels jump.
    """
    both = keep(edges.select("cls", "root").union(edges.select(F.col("root").alias("cls"), F.col("cls").alias("root"))).distinct(), "link-edges")
    if not both.take(1):
        return both
    label = both.groupBy("cls").agg(F.least(F.min("root"), F.col("cls")).alias("root"))
    label = keep(label, "link-labels")
    while True:
        far = both.select("cls", F.col("root").alias("by")).join(label.select(F.col("cls").alias("by"), F.col("root").alias("reach")), "by")
        near = far.groupBy("cls").agg(F.min("reach").alias("reach"))
        # written, so that the join on a label that very many share can be split
        step = keep(label.join(near, "cls").select("cls", F.col("root").alias("was"), F.least("root", "reach").alias("root")), "link-labels")
        jump = step.select(F.col("cls").alias("root"), F.col("root").alias("beyond"))
        step = keep(step.join(jump, "root", "left").select("cls", "was", F.least("root", F.coalesce("beyond", "root")).alias("root")), "link-labels")
        label = step.select("cls", "root")
        if not step.filter(F.col("was") != F.col("root")).take(1):
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Classes, numbers of links and groups of all documents; see the module's text."""
    small_batches(docs.sparkSession)
    n_bands, n_rows = choose_bands(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()
    ids = "bigint" if kind in _WHOLE else kind if kind in _IDS else "string"
    missing = F.lit(_IDS[ids][1])
    texts = docs.select(F.col(id_col).cast(ids).alias("doc_id"), "text")
    signed = keep(texts.mapInArrow(released(_sign(size, n_bands, n_rows)), f"doc_id {ids}, cls binary, n int, bands array<long>"), "signatures")
    classes = keep(
        signed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    places = classes.select("cls", "n", F.posexplode("bands").alias("band", "h"))
    shared = places.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("cls").alias("hub")).filter("c > 1")
    large = (F.col("c") > LARGE) | ((F.col("s") > LARGE_GRAMS) & (F.col("c") > 2))
    members = keep(places.drop("n").join(shared.withColumn("large", large).drop("c", "s"), ["band", "h"]), "bucket-members")
    families = components(members.filter("large and cls <> hub").select("cls", F.col("hub").alias("root"))).select("cls", F.col("root").alias("family"))
    signs = classes.select("cls", "bands").join(families, "cls", "left")
    scan = members.filter("not large").select("band", "h", "cls").join(signs, "cls").select(*_KEYS, "family", "cls", "bands")
    wanted = keep(_dealt(scan).mapInArrow(released(_scan), "band int, h long, cls binary"), "bucket-pairs")
    needed = keep(wanted.select("cls").union(families.select("cls")).distinct(), "needed-classes")
    chosen = classes.select("cls", "class_id").join(needed, "cls").select(F.coalesce("class_id", missing).alias("doc_id"), F.col("class_id").isNull().alias("unnamed")).distinct()
    # only texts that stand for a class with possible links are read into n-gram sets
    known = texts.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", missing))
    found = known.join(hashed_side(keep(chosen, "needed-ids")), ["doc_id", "unnamed"], "left_semi").select("doc_id", "text").mapInArrow(released(_sets(size)), "cls binary, grams binary")
    sets = keep(found.join(needed, "cls", "left_semi").dropDuplicates(["cls"]), "gram-sets")
    verify = wanted.join(classes.drop("bands").join(sets, "cls"), "cls").join(signs, "cls").select(*_KEYS, "family", "cls", "class_id", "copies", "n", "bands", "grams")
    paired = _dealt(verify).mapInArrow(released(_verify(threshold, ids)), _links(ids))
    if families.take(1):
        paired = paired.unionByName(family_links(classes, families, sets, threshold, ids))
    links = keep(paired, "links")
    # a vertex carries its class's id in front, so the smallest label tells the group's id itself
    vertex = lambda id_, cls: F.struct(F.col(id_).isNull().alias("unnamed"), F.coalesce(id_, missing).alias("id"), F.col(cls).alias("cls"))
    edges = links.filter(F.col("cls") != F.col("root_cls")).select(vertex("id", "cls").alias("cls"), vertex("root_id", "root_cls").alias("root"))
    roots = components(edges).select(F.col("cls.cls").alias("cls"), F.when(~F.col("root.unnamed"), F.col("root.id")).alias("group_id"))
    info = classes.select("cls", "class_id", "copies").join(links.groupBy("cls").agg(F.sum("links").alias("links"), F.min("low").alias("low")), "cls", "left").join(roots, "cls", "left")
    # written, so that the last join can split a class with a third of all rows
    info = keep(info.select("cls", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "low", F.coalesce("group_id", "class_id").alias("group_id")), "class-info")
    linked = signed.filter("n > 0").select("doc_id", "cls").join(info, "cls").select("doc_id", "class_id", F.col("copies").alias("n_copies"), F.col("links").alias("n_links"), F.col("low").alias("link_id"), "group_id")
    alone = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(ids).alias("link_id"), F.col("doc_id").alias("group_id"))
    return linked.unionByName(alone)
