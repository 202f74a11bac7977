"""Substring dedup: word windows that an earlier document has are removed from later ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import by_value
from lexloom.llm.hashing import U, chunks, covered, mix, planes, spans, unplanes, windows, words

#: Bytes of text whose windows one bucket holds, about 1.3 million of them, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Windows that a task combines before it sends them, and repeated ones it remembers of earlier lots.
LOT, REMEMBERED = 1 << 19, 1 << 18
#: Bytes that travel of each of a window's two hashes; the bucket's number holds other bits of the second.
WIDE, CHECK = 6, 2
_WIDE, _CHECK = U((1 << (8 * WIDE)) - 1), U((1 << (8 * CHECK)) - 1)
#: Lots: windows of documents, windows of rows of null id, windows known to be late.
_ENTRY, _NULL, _LATE = 0, 1, 2


def hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent rolling hashes of every window of `width` words, its first word, and each word's row."""
    starts, ends, rows = words(data, offsets)
    own = spans(data, starts, ends)
    one, first = windows(own, rows, width)
    two, _ = windows(mix(own ^ U(0x5DEECE66D2B7E151)), rows, width)
    return one, two, first, rows


def _order(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """An order that puts equal windows together; two windows of one first hash make it a slower one."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        return np.lexsort((docs, two, one))
    return order


def _runs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where runs of equal windows begin."""
    return np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))) if len(one) else np.zeros(0, np.int64)


def _pack(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    return planes(one & _WIDE, WIDE) + planes(two & _CHECK, CHECK), planes(np.diff(docs, prepend=np.int64(0)).view(U), 8)


def _unpack(blob: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // (WIDE + CHECK)
    return unplanes(blob[: n * WIDE], WIDE), unplanes(blob[n * WIDE :], CHECK), np.cumsum(unplanes(docs, 8).view(np.int64))


class _Hot:
    """The least document of windows that a task has seen repeated, as many as fit."""

    def __init__(self) -> None:
        self.one, self.two, self.least = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The least document known of each window, or the largest number."""
        out = np.full(len(one), np.iinfo(np.int64).max)
        if len(self.one):
            at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
            hit = (self.one[at] == one) & (self.two[at] == two)
            out[hit] = self.least[at[hit]]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, least: np.ndarray) -> None:
        one, two, least = np.concatenate([one, self.one]), np.concatenate([two, self.two]), np.concatenate([least, self.least])
        one, at = np.unique(one, return_index=True)  # the newer of two stays
        two, least = two[at], least[at]
        if len(one) > REMEMBERED:
            keep = np.sort(np.argsort(at)[:REMEMBERED])
            one, two, least = one[keep], two[keep], least[keep]
        self.one, self.two, self.least = one, two, least


def _scan(width: int, buckets: int):
    """(key, is null, text) to packed windows, one row for each bucket and lot.

    In a lot every window goes on once, for its least document; the others
    that have it are late whatever the rest of the corpus holds, and are sent
    on as such, past the buckets.
    """
    schema = ["bucket", "kind", "hashes", "docs"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def dealt(kind: int, one: np.ndarray, two: np.ndarray, docs: np.ndarray, out: list[tuple]) -> None:
        bucket = ((two >> U(8 * CHECK)) % U(buckets)).astype(np.int32)
        order = np.lexsort((docs, bucket))
        bucket, one, two, docs = bucket[order], one[order], two[order], docs[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(bucket))):
            out.append((int(bucket[a]), kind, *_pack(one[a:b], two[a:b], docs[a:b])))

    def lot(parts: list[tuple], hot: _Hot) -> pa.RecordBatch:
        one, two, docs, null = (np.concatenate(x) for x in zip(*parts))
        rows: list[tuple] = []
        dealt(_NULL, one[null], two[null], docs[null], rows)
        one, two, docs = one[~null], two[~null], docs[~null]
        order = _order(one, two, docs)
        one, two, docs = one[order], two[order], docs[order]
        at = _runs(one, two)
        if len(at):
            count = np.diff(np.append(at, len(one)))
            least = np.minimum.reduceat(docs, at)
            before = hot.find(one[at], two[at])
            bound = np.repeat(np.minimum(least, before), count)
            late = np.flatnonzero(docs > bound)
            late = late[np.lexsort((one[late], docs[late]))]
            if len(late):
                new = np.concatenate(([True], (docs[late][1:] != docs[late][:-1]) | (one[late][1:] != one[late][:-1]) | (two[late][1:] != two[late][:-1])))
                late = late[new]
                for lo in range(0, len(late), 1 << 17):
                    own = late[lo : lo + (1 << 17)]
                    rows.append((int(mix(two[own[:1]])[0] % U(buckets)), _LATE, *_pack(one[own], two[own], docs[own])))
            send = least < before
            dealt(_ENTRY, one[at][send], two[at][send], least[send], rows)
            again = (np.maximum.reduceat(docs, at) > least) | (before < np.iinfo(np.int64).max)
            hot.add(one[at][again], two[at][again], np.minimum(least, before)[again])
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, n = _Hot(), [], 0
        for batch in batches:
            ids, null = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, _, data, offsets in chunks(batch.column(2)):
                one, two, first, rows = hashes(data, offsets, width)
                own = rows[first]
                held.append((one, two, ids[i:][own].astype(np.int64), null[i:][own]))
                n += len(one)
                if n >= LOT:
                    yield lot(held, hot)
                    held, n = [], 0
        if held:
            yield lot(held, hot)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed windows, sorted by bucket: those of each document that a smaller id also has."""

    def rows(one: np.ndarray, two: np.ndarray, docs: np.ndarray, null: bool) -> Iterator[pa.RecordBatch]:
        if not len(docs):
            return
        order = np.argsort(docs, kind="stable")
        one, two, docs = one[order], two[order], docs[order]
        flat = np.concatenate([one.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE], two.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK]], 1).tobytes()
        at = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        each = WIDE + CHECK
        for lo in range(0, len(at), 20_000):  # a batch of rows at a time
            part = at[lo : lo + 20_000]
            stop = at[lo + 20_000] if lo + 20_000 < len(at) else len(docs)
            offsets = ((np.append(part, stop) - part[0]) * each).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[part[0] * each : stop * each])])
            yield pa.RecordBatch.from_arrays([pa.array(docs[part], pa.int64()), pa.array(np.full(len(part), null)), blob], ["_k", "_null", "_h"])

    def judged(entries: list[tuple], nulls: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not entries:
            return
        one, two, docs = (np.concatenate(x) for x in zip(*entries))
        order = _order(one, two, docs)
        one, two, docs = one[order], two[order], docs[order]
        at = _runs(one, two)
        least = np.repeat(np.minimum.reduceat(docs, at), np.diff(np.append(at, len(one))))
        late = docs > least
        yield from rows(one[late], two[late], docs[late], False)
        if nulls:
            first, second, keys = (np.concatenate(x) for x in zip(*nulls))
            found = member(first, second, one[at], two[at])
            yield from rows(first[found], second[found], keys[found], True)

    now, entries, nulls = None, [], []
    for batch in batches:
        for b, kind, h, d in zip(*(batch.column(i) for i in range(4))):
            kind = kind.as_py()
            if kind == _LATE:
                yield from rows(*_unpack(h.as_py(), d.as_py()), False)
                continue
            if now is not None and b.as_py() != now:
                yield from judged(entries, nulls)
                entries, nulls = [], []
            now = b.as_py()
            (nulls if kind == _NULL else entries).append(_unpack(h.as_py(), d.as_py()))
    yield from judged(entries, nulls)


def member(one: np.ndarray, two: np.ndarray, known: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which windows (one, two) are among (known, check)."""
    found = np.zeros(len(one), bool)
    if not len(known):
        return found
    order = np.lexsort((check, known))
    known, check = known[order], check[order]
    at = np.searchsorted(known, one)
    while True:  # once, but for windows that share a first hash
        inside = at < len(known)
        inside[inside] = known[at[inside]] == one[inside]
        if not inside.any():
            return found
        found[inside] |= check[at[inside]] == two[inside]
        at = at + 1


def _cut(width: int):
    """(doc_id, text, late windows) to the word counts and the text that is left."""
    each = WIDE + CHECK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gone = batch.column(0), batch.column(2)
            for i, j, data, offsets in chunks(batch.column(1)):
                one, two, first, rows = hashes(data, offsets, width)
                one, two = one & _WIDE, two & _CHECK
                at = np.searchsorted(rows, np.arange(j - i + 1))
                own = np.searchsorted(first, at)  # where a row's windows begin
                n_removed, kept = [], []
                for r in range(j - i):
                    lo, hi = at[r], at[r + 1]
                    tokens = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    found = gone[i + r].as_py()
                    removed = 0
                    if found and own[r + 1] > own[r]:
                        raw = np.frombuffer(b"".join(found), np.uint8).reshape(-1, each)
                        known, check = np.zeros((len(raw), 8), np.uint8), np.zeros((len(raw), 8), np.uint8)
                        known[:, :WIDE], check[:, :CHECK] = raw[:, :WIDE], raw[:, WIDE:]
                        a, b = own[r], own[r + 1]
                        hit = member(one[a:b], two[a:b], known.view("<u8").ravel(), check.view("<u8").ravel())
                        out = covered(first[a:b][hit] - lo, width, int(hi - lo))
                        removed = int(out.sum())
                        if removed:
                            tokens = [t for t, x in zip(tokens, out.tolist()) if not x]
                    n_removed.append(removed)
                    kept.append(b" ".join(tokens).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, width: int = 13, buckets: int | None = None, digest: bool = False) -> DataFrame:
    r"""doc_id, n_words, n_removed (long) and kept_text (or, with digest, kept_sha256).

    Words are [^\x20\x09-\x0D]+.  Every word covered by a window of `width`
    words whose sequence also starts in a document of a smaller id is removed;
    windows are judged on the input.  Overlapping windows merge into maximal
    intervals, and the words left are joined by one space.

    A null text has no words; texts shorter than a window lose none.  Rows that
    share an id are one document (they take nothing from each other); rows of
    null id come after all others and take nothing from each other either.
    Very long texts are windows like any others.  An empty table gives an empty
    one; other columns of docs, whatever their names, are ignored.

    Windows are known by two independent rolling hashes: 64 bits travel and the
    bucket's number adds its own.  A window meets the million or so others of
    its bucket, so of N windows about N x 7e-14 are ever taken for another one.
    They are counted by bucket, packed in byte planes,
    not a row a window; a bucket holds the windows of BUCKET_BYTES of text
    (their number comes from the summed length of all texts), and a task holds
    one bucket at a time.  Each task first combines its windows, lot by lot, to
    one entry a window with its least document, so that a window that every
    document has is one entry a task in its bucket; what is late already is
    sent past the buckets.  Documents then meet their late windows by id.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if buckets is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    null = F.col("doc_id").isNull()
    key = F.coalesce("doc_id", F.xxhash64("text"))
    packed = docs.select(key.alias("k"), null.alias("n"), "text").mapInArrow(_scan(width, buckets), "bucket int, kind int, hashes binary, docs binary")
    late = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "_k long, _null boolean, _h binary")
    late = late.groupBy("_k", "_null").agg(F.collect_list("_h").alias("_h"))
    joined = docs.withColumns({"_k2": key, "_n2": null}).join(late, (F.col("_k2") == F.col("_k")) & (F.col("_n2") == F.col("_null")), "left").select("doc_id", "text", "_h")
    cut = _cut(width)
    if digest:
        return joined.mapInArrow(lambda batches: _digest(cut(batches)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


by_value(__name__)
