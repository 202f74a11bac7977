"""N-gram Jaccard self-join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import apart, by_value, checkpoint, components, union_find
from lexloom.llm.hashing import U, chunks, mix, spans, windows, words

#: Sets of one block of a band bucket, and n-grams in them: larger buckets meet block by block.
BLOCK, BLOCK_GRAMS = 512, 2_000_000
#: N-grams (columns) that a block's incidence matrix holds at once.
COLUMNS = 4096


def banding(similarity: float, recall: float, hashes: int = 100) -> tuple[int, int]:
    """(bands, rows): a pair of just that similarity shares a band with probability `recall` at least.

    Each number of rows needs some number of bands for that.  More rows make
    unlike pairs rarer candidates but need more hash functions, so the most
    rows that stay within `hashes` functions are taken (one if none does).
    """
    need = lambda rows: max(1, math.ceil(math.log(1 - recall) / math.log1p(-(min(similarity, 1 - 1e-9) ** rows))))
    rows = max((r for r in range(1, hashes + 1) if similarity**r * hashes > 1e-6 and need(r) * r <= hashes), default=1)
    return need(rows), rows


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, sorted within each row, and their rows; a shorter text has all its words as one."""
    starts, ends, rows = words(data, offsets)
    hashes = spans(data, starts, ends)
    keys, first = windows(hashes, rows, width)
    owner = rows[first]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.searchsorted(rows, short)
        extra = [mix(np.bitwise_xor.reduce(mix(hashes[a : a + counts[r]] + np.arange(1, counts[r] + 1, dtype=U)), keepdims=True)) for r, a in zip(short, at)]
        keys, owner = np.concatenate([keys, *extra]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]


def _fingerprint(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, from where the sets begin."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.add.reduceat(mix(keys ^ U(0xA5A5)), at).view(np.int64), np.add.reduceat(mix(keys ^ U(0x5A5A)), at).view(np.int64)


def _signatures(width: int, bands: int, rows_each: int):
    rng = np.random.default_rng(97)
    scale = rng.integers(1, 2**63, bands * rows_each, dtype=np.uint64) * U(2) + U(1)
    shift = rng.integers(0, 2**63, bands * rows_each, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                keys, owner = shingles(data, offsets, width)
                has = np.unique(owner)
                at = np.searchsorted(owner, has)
                sign = np.zeros((bands, len(has)), U)
                if len(has):
                    for k in range(bands * rows_each):
                        least = np.minimum.reduceat(keys * scale[k] + shift[k], at)
                        b = k // rows_each
                        sign[b] = mix((sign[b] + U(b + 1)) ^ least)
                one, two = _fingerprint(keys, at)
                size = np.diff(np.append(at, len(keys)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * bands, pa.int32()), pa.array(sign.T.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(has)), pa.array(one), pa.array(two), pa.array(size, pa.int64()), batch.column(2).slice(i, j - i).take(pa.array(has)), flat], ["doc_id", "f1", "f2", "size", "text_hash", "bands"])

    return run


def _sets(width: int):
    """(e, f1, f2, text) to (e, set): the n-gram hashes of the rows whose text has that fingerprint, once an e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(3)):
                keys, owner = shingles(data, offsets, width)
                has = np.unique(owner)
                at = np.searchsorted(owner, has)
                stop = np.append(at[1:], len(keys))
                one, two = _fingerprint(keys, at)
                e, f1, f2 = (batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False)[has] for c in range(3))
                good = [k for k in np.flatnonzero((one == f1) & (two == f2)).tolist() if int(e[k]) not in seen]
                good = list({int(e[k]): k for k in reversed(good)}.values())
                seen.update(int(e[k]) for k in good)
                yield pa.RecordBatch.from_arrays([pa.array([int(e[k]) for k in good], pa.int64()), pa.array([keys[at[k] : stop[k]].astype("<u8").tobytes() for k in good], pa.binary())], ["e", "grams"])

    return run


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left[i] and right[j] where near[i, j]; each set is sorted and distinct."""
    out = np.zeros(near.shape, np.int64)
    i, j = np.nonzero(near)
    size = np.array([len(s) for s in sets])
    keys, column = np.unique(np.concatenate(sets), return_inverse=True)
    useful = np.bincount(column, minlength=len(keys)) > 1
    width = int(useful.sum())
    if 400 * int(np.minimum(size[left[i]], size[right[j]]).sum()) <= near.size * width:  # few pairs: one by one
        own: dict[int, frozenset] = {}
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = (own[k] if k in own else own.setdefault(k, frozenset(sets[k].tolist())) for k in (int(left[a]), int(right[b])))
            out[a, b] = len(x & y)
        return out
    kept = useful[column]
    row, column = np.repeat(np.arange(len(sets)), size)[kept], (np.cumsum(useful) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros(near.shape, np.float32)
    for lo in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, width - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        total += x[left] @ x[right].T
    out[i, j] = np.rint(total[i, j]).astype(np.int64)
    return out


def _verify(similarity: float):
    """Pairs of blocks of band buckets, sorted by (key, low, high), to each set's links and a spanning forest of them."""

    def group(rows: dict[str, list], out: list[tuple[int, int, int]]) -> None:
        band, low, high = rows["band"][0], rows["low"][0], rows["high"][0]
        first: dict[int, int] = {}
        for k, e in enumerate(rows["e"]):
            first.setdefault(e, k)
        at = list(first.values())
        e, copies, side = ([rows[c][k] for k in at] for c in ("e", "copies", "block"))
        sets = [np.frombuffer(rows["grams"][k], "<u8") for k in at]
        signs = np.array([rows["bands"][k] for k in at], np.int64)
        side = np.array(side)
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        if not len(left) or not len(right):
            return
        near = signs[left, band][:, None] == signs[right, band][None, :]
        for b in range(band):  # a pair is judged in the first band it shares
            near &= signs[left, b][:, None] != signs[right, b][None, :]
        if low == high:
            near = np.triu(near, 1)
        size = np.array([len(s) for s in sets])
        near &= np.minimum.outer(size[left], size[right]) >= similarity * np.maximum.outer(size[left], size[right])
        if not near.any():
            return
        both = shared(sets, left, right, near)
        near &= both >= similarity * (size[left][:, None] + size[right][None, :] - both)
        links = [0] * len(e)
        find, join = union_find(len(e))
        for a, b in zip(*np.nonzero(near)):
            i, j = int(left[a]), int(right[b])
            links[i] += copies[j]
            links[j] += copies[i]
            join(i, j)
        out += [(e[i], links[i], e[find(i)]) for i in range(len(e)) if links[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "low", "high", "block", "band", "e", "copies", "bands", "grams")
        held: dict[str, list] = {c: [] for c in names}
        now: tuple | None = None
        out: list[tuple[int, int, int]] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["e", "links", "root"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = {c: batch.column(k).slice(lo, 256).to_pylist() for k, c in enumerate(names)}
                triples = list(zip(part["key"], part["low"], part["high"]))
                cut = [0, *(k for k in range(1, len(triples)) if triples[k] != triples[k - 1]), len(triples)]
                for a, b in zip(cut, cut[1:]):
                    if now is not None and now != triples[a]:
                        group(held, out)
                        held = {c: [] for c in names}
                    now = triples[a]
                    for c in names:
                        held[c] += part[c][a:b]
                if len(out) > 5000:
                    yield emit()
        if now is not None:
            group(held, out)
        yield emit()

    return run


def jaccard_join(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.999, by_row: bool = False) -> DataFrame:
    r"""One row a document: doc_id, class_id and n_links; with by_row, text_hash (xxhash64 of the text) too.

    Words are [^\x20\x09-\x0D]+, n-grams `width` consecutive ones (a shorter
    text is one n-gram of all its words).  n_links is the number of other
    documents whose n-gram set has a Jaccard similarity of at least
    `similarity`; class_id is the smallest id reachable over links.

    A text without words (or null) has no n-grams, and so no links and its own
    class.  Rows that repeat an id, with the same text or another one, are one
    document for classes and are each counted as a link's end; a row of null
    id has a null class and no links.  Very long texts are one set like any
    other.  With by_row every row is a document of its own: equal ids tie
    nothing.  An empty table gives an empty one; other columns of docs, whatever
    their names, are ignored.

    Band and row counts are chosen so that a pair of just that similarity
    shares a band with probability `recall`.  Equal n-gram sets are first
    merged by a 128-bit fingerprint, so copies never meet each other: a set
    goes on with a number of its own, its least id and its count.  Sets meet
    in the buckets of their band hashes; of buckets with the same members one
    stays.  A bucket of more than BLOCK sets is dealt into blocks, and a task
    gets the n-gram hashes of two blocks, each set once.  It judges the pairs
    whose first shared band this is on their full sets, all at once as a
    product of incidence matrices, and gives back a count for each set and a
    spanning forest.  No pairs are ever rows, and only sets in a bucket with
    others are read and shipped.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    out = ["doc_id", *(["text_hash"] if by_row else []), "class_id", "n_links"]
    bands, rows_each = banding(similarity, recall)
    signs = checkpoint(docs.where("doc_id is not null").mapInArrow(_signatures(width, bands, rows_each), "doc_id long, f1 long, f2 long, size long, text_hash long, bands array<long>"))
    sets = signs.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.any_value("bands").alias("bands"))
    sets = checkpoint(sets.withColumn("e", F.monotonically_increasing_id()))
    keys = sets.select("e", "size", F.posexplode("bands").alias("band", "key"))
    # Members as two hashes, so that buckets with the same ones can be told without listing them.
    same = [F.bit_xor(F.xxhash64("e")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "e")).alias("m2")]
    buckets = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), *same).where("n > 1")
    buckets = buckets.groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "key", "grams")).alias("b"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("b.grams") / BLOCK_GRAMS)).cast("int")
    buckets = buckets.select(apart("b.key").alias("_k"), F.col("b.band").alias("_b"), blocks.alias("m"))
    spots = keys.join(buckets, (apart("key") == F.col("_k")) & (F.col("band") == F.col("_b")))
    spots = checkpoint(spots.select(F.col("e").alias("_e"), "key", "band", F.pmod(F.xxhash64("e"), F.col("m")).cast("int").alias("block"), "m"))
    needed = spots.select("_e").distinct().join(sets, F.col("_e") == F.col("e")).select("e", "rep", "f1", "f2")
    texts = needed.join(docs, F.col("rep") == F.col("doc_id")).select("e", "f1", "f2", "text")
    grams = texts.mapInArrow(_sets(width), "e long, grams binary")
    rows = spots.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("_e", "key", "band", "block", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"))
    places = rows.groupBy("_e").agg(F.collect_list(F.struct("key", "low", "high", "block", "band")).alias("_p"))
    members = sets.select("e", "copies", "bands").join(places, F.col("e") == F.col("_e")).select(F.col("e").alias("_s"), "copies", "bands", "_p")
    placed = grams.join(members, F.col("e") == F.col("_s")).select("e", "copies", "bands", "grams", F.inline("_p"))
    met = placed.select("key", "low", "high", "block", "band", "e", "copies", "bands", "grams").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = checkpoint(met.mapInArrow(_verify(similarity), "e long, links long, root long"))
    links = found.groupBy(F.col("e").alias("_n")).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("e").alias("a"), F.col("root").alias("b"))
    if not by_row:  # an id with several texts ties their sets
        tied = signs.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("a"), F.max(F.struct("f1", "f2")).alias("b")).where("a <> b").select(F.col("doc_id").alias("_d"))
        tied = signs.join(tied, F.col("doc_id") == F.col("_d")).select("doc_id", F.col("f1").alias("g1"), F.col("f2").alias("g2")).distinct()
        tied = tied.join(sets, (F.col("g1") == F.col("f1")) & (F.col("g2") == F.col("f2"))).select("doc_id", "e")
        hubs = tied.groupBy(F.col("doc_id").alias("_d")).agg(F.min("e").alias("root"))
        edges = edges.unionByName(tied.join(hubs, F.col("doc_id") == F.col("_d")).select(F.col("e").alias("a"), F.col("root").alias("b")))
    edges = checkpoint(edges.where("a <> b").distinct())
    ends = edges.select(F.col("a").alias("e")).unionByName(edges.select(F.col("b").alias("e"))).distinct()
    groups = components(ends, edges, "e", "label").select(F.col("e").alias("_g"), "label")
    least = groups.join(sets, F.col("_g") == F.col("e")).groupBy(F.col("label").alias("_l")).agg(F.min("rep").alias("class"))
    groups = checkpoint(groups.join(least, apart("label") == apart("_l")).select("_g", "class"))
    done = sets.join(groups, F.col("e") == F.col("_g"), "left").join(links, F.col("e") == F.col("_n"), "left")
    done = done.select(apart("f1").alias("s1"), F.col("f2").alias("s2"), F.coalesce("class", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = signs.join(done, (apart("f1") == F.col("s1")) & (F.col("f2") == F.col("s2"))).select(*out)
    bare = docs.select("doc_id", "text_hash", F.coalesce("text", F.lit("")).alias("t")).where("doc_id is null or not t rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    bare = bare.withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    return known.unionByName(bare.select(*out))


by_value(__name__)
