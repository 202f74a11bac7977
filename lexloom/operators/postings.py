"""An inverted index in segments: compressed postings sorted by document, with block maxima, and a merge of them.

Where documents are read they become segments of bounded size; nothing is
shuffled for that.  A segment's row of term null has its documents' ids in
order and their lengths; each other row has one term's postings.  These are
variable-length integers: a header of four for each block of BLOCK postings
(its last document less the block's before, its bytes, its largest count, its
shortest document's length), then gap and count of each posting, a block's first one from 0.
"""

from __future__ import annotations

import heapq
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Postings of a block; bytes of text (arrays made of it take some twenty times as much) and documents of a segment; rows of an Arrow batch given back.
BLOCK, SEGMENT_BYTES, SEGMENT_DOCS, ROWS = 128, 8 << 20, 1 << 16, 1 << 13
#: Cells of questions and documents that are summed at once; postings that are packed at once, a term's own excepted.
CELLS, PIECE = 1 << 19, 1 << 16

_ALL = np.arange(256)
#: Bytes inside a token: all but white space; and ASCII letters, digits and everything beyond ASCII.
NO_BLANK = ~np.isin(_ALL, [0x20, 9, 10, 11, 12, 13])
ALNUM = (_ALL >= 0x80) | np.isin(_ALL, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
_LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


# ---- integers ----


def _sizes(v: np.ndarray) -> np.ndarray:
    return 1 + sum((v >= (1 << (7 * b))).astype(np.int64) for b in range(1, 10 if len(v) and v.max() >= 1 << 35 else 5))


def packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of variable-length integers, low seven bits first, and where each one ends."""
    size = _sizes(v)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    start, b = end - size, 0
    while len(v):
        out[start + b] = (v & 127) | ((size > b + 1) << 7)
        more = size > b + 1
        v, size, start, b = v[more] >> 7, size[more], start[more], b + 1
    return out, end


def unpacked(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    v, b = np.zeros(len(end), np.int64), 0
    left = np.arange(len(end))
    while len(left):
        v[left] |= (data[start[left] + b].astype(np.int64) & 127) << (7 * b)
        b += 1
        left = left[start[left] + b <= end[left]]
    return v


# ---- a segment's tokens and postings ----


def token_lists(texts: pa.Array, inside: np.ndarray, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, number of each token's term, its row) of a string column; a null text has none."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    own = np.zeros(len(data) + 2, bool)
    own[1:-1] = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(own[1:] & (~own[:-1] | cut))
    places = np.flatnonzero(own[:-1] & (~own[1:] | cut))  # where they end
    places -= starts
    places = np.concatenate(([0], np.cumsum(places)))
    flat = data[own[1:-1]]
    del own, cut
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(flat)]).dictionary_encode()
    return coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy(), np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(starts, offsets)))


def segment_postings(texts: pa.Array, inside: np.ndarray, lower: bool, asked: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(lengths, terms, document frequencies, packed postings) of documents in their order.

    With asked, its terms come first, and they alone have postings.
    """
    terms, token, row = token_lists(texts, inside, lower)
    n = max(1, len(texts))
    lengths = np.bincount(row, minlength=len(texts))
    key = token.astype(np.int64)
    key *= n
    key += row
    del token, row
    key.sort()
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(key)).astype(np.int32)
    key = key[first]
    del new, first
    term, doc = (key // n).astype(np.int32), (key % n).astype(np.int32)
    df = np.bincount(term, minlength=len(terms))
    if not len(key):
        return lengths, terms, df, pa.array([], pa.large_binary())
    del key
    n_terms, every = len(terms), df
    if asked is not None:
        wanted = pa.compute.is_in(terms, value_set=asked).to_numpy(zero_copy_only=False)
        order = np.argsort(~wanted, kind="stable")
        n_terms, every = int(wanted.sum()), df[order]
        terms, own = terms.take(pa.array(order)), wanted[term]
        doc, count, df = doc[own], count[own], every[:n_terms]
        if not n_terms:
            return lengths, terms, every, pa.array([], pa.large_binary())
    del term
    # Terms are packed a piece at a time: what is made of their postings takes some twenty times as much as these.
    stop, parts, ends, lo = np.cumsum(df), [], [np.zeros(1, np.int64)], 0
    while lo < n_terms:
        start = int(stop[lo] - df[lo])
        hi = max(lo + 1, int(np.searchsorted(stop, start + PIECE, "right")))
        some = slice(start, int(stop[hi - 1]))
        data, end = _packed_terms(doc[some].astype(np.int64), count[some].astype(np.int64), df[lo:hi], lengths)
        parts.append(data)
        ends.append(end + ends[-1][-1])
        lo = hi
    return lengths, terms, every, pa.Array.from_buffers(pa.large_binary(), n_terms, [None, pa.py_buffer(np.concatenate(ends)), pa.py_buffer(np.concatenate(parts))])


def _packed_terms(doc: np.ndarray, count: np.ndarray, df: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of terms' postings, df of each, and where each term's end."""
    before = np.cumsum(df) - df
    place = np.arange(len(doc)) - np.repeat(before, df)
    opens = np.flatnonzero(place % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[opens] = doc[opens]
    pairs = np.stack((gap, count), 1).ravel()
    blocks = -(-df // BLOCK)
    last = doc[np.concatenate((opens[1:], [len(doc)])) - 1]
    head = np.stack((last, np.add.reduceat(_sizes(pairs), 2 * opens), np.maximum.reduceat(count, opens), np.minimum.reduceat(lengths[doc], opens)), 1)
    head[1:, 0] -= np.where(place[opens[1:]] > 0, last[:-1], 0)
    stream = np.empty(head.size + pairs.size, np.int64)
    heads = np.repeat(4 * np.cumsum(blocks) + 2 * before, 4 * blocks) - np.repeat(4 * np.cumsum(blocks), 4 * blocks) + np.arange(head.size)
    stream[heads] = head.ravel()
    rest = np.ones(len(stream), bool)
    rest[heads] = False
    stream[rest] = pairs
    data, end = packed(stream)
    return data, end[np.cumsum(4 * blocks + 2 * df) - 1]


def index_schema(docs: DataFrame, id_col: str, group: str | None) -> T.StructType:
    own = [T.StructField("grp", docs.schema[group].dataType)] if group else []
    return T.StructType([T.StructField("shard", T.LongType()), *own, *T.StructType.fromDDL("term string, df int, postings binary, words long").fields, T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType))])


def segments(docs: DataFrame, id_col: str, text_col: str, inside: np.ndarray = NO_BLANK, lower: bool = False, group: str | None = None, asked=None) -> DataFrame:  # noqa: ANN001
    """The index's rows (see above): shard, [grp], term, df, postings, words, ids.

    A segment's documents have one group and are sorted by id, nulls last; rows
    that share an id are documents of their own.  In a segment's own row df
    counts its documents that have a term, and words all terms with repeats.
    With asked (a broadcast array of terms) the other terms have null postings.
    """
    schema = index_schema(docs, id_col, group)
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])
    keys = [*(["g"] if group else []), "d"]

    def rows(table: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
        ids, texts = table["d"].combine_chunks(), table["t"].combine_chunks()
        lengths, terms, df, postings = segment_postings(texts.cast(pa.large_string()), inside, lower, asked and asked.value)
        own = table["g"][:1].combine_chunks() if group else None
        for at in (-1, *range(0, len(terms), ROWS)):  # the segment's own row, then its terms
            n = 1 if at < 0 else min(ROWS, len(terms) - at)
            if at < 0:
                cols = {"term": pa.nulls(1, pa.string()), "df": pa.array([int((lengths > 0).sum())], pa.int32()), "postings": pa.array([packed(lengths)[0].tobytes()], pa.binary()), "words": pa.array([int(lengths.sum())], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
            else:
                held = max(0, min(n, len(postings) - at))  # those without postings come last
                data = pa.concat_arrays([postings.slice(at, held).cast(pa.binary()), pa.nulls(n - held, pa.binary())])
                cols = {"term": terms.slice(at, n).cast(pa.string()), "df": pa.array(df[at : at + n], pa.int32()), "postings": data, "words": pa.nulls(n, pa.int64()), "ids": pa.nulls(n, out.field("ids").type)}
            cols["shard"] = pa.array(np.full(n, shard))
            if group:
                cols["grp"] = own.take(pa.array(np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for table in _bounded(batches):
            order = pa.compute.sort_indices(table, [(k, "ascending") for k in keys], null_placement="at_end")
            table = table.take(order)
            for part in _runs(table, "g") if group else (table,):
                yield from rows(part, shard)
                shard += 1

    return docs.select(*([F.col(group).alias("g")] if group else []), F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else to_arrow_type(kind)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of a bounded number and size, one long text excepted."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lengths):
            upto = at + int(np.searchsorted(np.cumsum(lengths[at:]), SEGMENT_BYTES - size, "right"))
            upto = min(max(upto, at + (not held)), at + SEGMENT_DOCS - n, len(lengths))
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                n += upto - at
            at = upto
            if at < len(lengths):
                yield pa.Table.from_batches(held)
                held, size, n = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, key: str) -> Iterator[pa.Table]:
    values, first = table[key].combine_chunks(), 0
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy()
    for stop in [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]:
        yield table.slice(first, stop - first)
        first = stop


# ---- the merge ----

Impact = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Postings:
    """One term's postings in a segment: block bounds from the header, blocks decoded when they are met.

    impact(counts, lengths of documents) is what a posting is worth; it must
    grow with the count and fall with the length, or be of a negative sign.
    """

    def __init__(self, data: bytes, df: int, lengths: np.ndarray, impact: Impact) -> None:
        raw = np.frombuffer(data, np.uint8)
        n = -(-df // BLOCK)
        heads = 4 * n
        stop = int(np.flatnonzero(raw[: 10 * heads] < 128)[heads - 1]) + 1
        head = unpacked(raw[:stop]).reshape(n, 4)
        ends = stop + np.cumsum(head[:, 1])
        self.last = np.cumsum(head[:, 0]).tolist()
        self.edges = [stop, *ends.tolist()]
        self.raw, self.lengths, self.impact, self.df = raw, lengths, impact, df
        top = impact(head[:, 2], head[:, 3])
        self.tops = np.maximum(top, 0).tolist()
        self.top = max(self.tops)
        self.blocks: dict[int, tuple[list[int], list]] = {}
    def block(self, i: int) -> tuple[list[int], list]:
        """(documents, impacts) of block i."""
        if i not in self.blocks:
            pairs = unpacked(self.raw[self.edges[i] : self.edges[i + 1]]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0])
            self.blocks[i] = docs.tolist(), self.impact(pairs[:, 1], self.lengths[docs]).tolist()
        return self.blocks[i]


def best_documents(lists: list[tuple[Postings, int]], k: int, least: float, slack: float = 0, places: int | None = None) -> list[tuple[float, int]]:
    """(score, document) of the k best of a segment's documents that score over `least`, the best first, equal ones by document.

    A document's score is the sum of its postings' impacts times their list's
    factor.  Documents are met in order by a heap of cursors, one of each list
    that alone could still bring a document among the best; lists whose bounds
    together can't are only looked up, block by block, and not at all where the
    block's bound can't.  A heap of k holds the best so far.  Scores may be
    rounded to `places`; then `slack` must cover that.
    """
    lists = sorted(lists, key=lambda x: x[0].top * x[1])
    factor, own = [f for _, f in lists], [p for p, _ in lists]
    sums, total = [], 0
    for p, f in lists:
        total += p.top * f
        sums.append(total)
    shift = max(1, len(lists).bit_length())
    mask = (1 << shift) - 1
    limit, first, n = least - slack, 0, len(lists)
    best: list[tuple[float, int]] = []

    def essential(at: int) -> int:
        while at < n and sums[at] <= limit:
            at += 1
        return at

    first = essential(0)
    number, docs, worth, place = [0] * n, [None] * n, [None] * n, [0] * n
    heap = []
    for i in range(first, n):
        docs[i], worth[i] = own[i].block(0)
        heap.append(docs[i][0] << shift | i)
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0] >> shift, 0
        while heap and heap[0] >> shift == doc:
            i = heap[0] & mask
            at = place[i]
            score += worth[i][at] * factor[i]
            at += 1
            if at == len(docs[i]):
                number[i] += 1
                if number[i] == len(own[i].last):
                    heapq.heappop(heap)
                    continue
                docs[i], worth[i] = own[i].block(number[i])
                at = 0
            place[i] = at
            heapq.heapreplace(heap, docs[i][at] << shift | i)
        rest = first - 1
        while rest >= 0 and score + sums[rest] > limit:
            p = own[rest]
            b = bisect_left(p.last, doc)
            if b < len(p.last):
                if score + p.tops[b] * factor[rest] + (sums[rest - 1] if rest else 0) <= limit:
                    break
                there, value = p.block(b)
                at = bisect_left(there, doc)
                if at < len(there) and there[at] == doc:
                    score += value[at] * factor[rest]
            rest -= 1
        if rest >= 0:
            continue
        if places is not None:
            score = round(score, places) + 0.0
        if score <= (best[0][0] if len(best) == k else least):
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -doc))
        else:
            heapq.heapreplace(best, (score, -doc))
        if len(best) == k and best[0][0] - slack > limit:
            limit = best[0][0] - slack
            if (now := essential(first)) > first:
                first = now
                heap = [x for x in heap if x & mask >= first]
                heapq.heapify(heap)
    return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def all_postings(data: pa.Array, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of the postings of several terms, one term's after the other's, all decoded at once."""
    edges = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    held = data.buffers()[2]
    stream = unpacked(np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None and len(df) else np.zeros(0, np.uint8))
    blocks = -(-df // BLOCK)
    before = np.cumsum(4 * blocks + 2 * df) - 2 * df  # where each term's pairs begin
    first = np.cumsum(df) - df
    at = np.repeat(before - 2 * first, df) + 2 * np.arange(int(df.sum()))
    gap, count = stream[at], stream[at + 1]
    docs = np.cumsum(gap)
    opens = np.repeat(first - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(int(blocks.sum()))
    sizes = np.diff(np.append(opens, len(gap)))
    return docs - np.repeat(docs[opens] - gap[opens], sizes), count


def best_by_cells(docs: np.ndarray, worth: np.ndarray, first: np.ndarray, df: np.ndarray, question: np.ndarray, term: np.ndarray, factor: np.ndarray, k: int, n_docs: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, document, score) of the k best of a segment's documents for each question, equal ones by document.

    docs and worth are the segment's postings by term, from first[term] on,
    df[term] of them; question (ascending), term and factor are the questions'
    terms that it has.  A document is found if it has a term of the question.
    Cells of a question and a document are summed a bounded number at once,
    which a question alone can exceed by the segment's postings.
    """
    found = []
    starts = np.flatnonzero(np.concatenate(([True], question[1:] != question[:-1]))) if len(question) else np.zeros(0, np.int64)
    cost = np.maximum(np.add.reduceat(df[term], starts), n_docs) if len(starts) else starts
    stops, lo = np.append(starts[1:], len(question)), 0
    while lo < len(starts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(cost[lo:]), CELLS, "right")))
        some = slice(starts[lo], stops[hi - 1])
        own, n = term[some], df[term[some]]
        row = np.repeat(np.arange(hi - lo), stops[lo:hi] - starts[lo:hi])
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(row * n_docs, n) + docs[at]
        score = np.bincount(cell, worth[at] * np.repeat(factor[some], n), (hi - lo) * n_docs)
        score = np.round(score, places) + 0.0
        met = np.zeros(len(score), bool)
        met[cell] = True
        score[~met] = -np.inf
        score = score.reshape(hi - lo, n_docs)
        bar = np.partition(score, n_docs - k, 1)[:, n_docs - k, None] if n_docs > k else -np.inf
        i, j = np.nonzero((score >= bar) & met.reshape(score.shape))
        value = score[i, j]
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        found.append((question[starts[lo:hi]][i[best]], j[best], value[best]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
