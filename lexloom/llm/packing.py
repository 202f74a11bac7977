"""Packing tokenised documents into sequences: Martello-Toth dominance, then best fit."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import by_value, checkpoint, distributed_rank, worker_cache

#: Code points below this split alike in both tokenizer libraries; other texts go through the slower one.
PLAIN = 0x250
SPECIAL = "<|endoftext|>"


def tokenizer(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> dict:
    """What executors need to tokenise: the files' bytes, read once on the driver."""
    with open(json_path, encoding="utf-8") as f:
        model = {"json": f.read()}
    if ranks_path and pattern:
        with open(ranks_path, "rb") as f:
            model |= {"ranks": f.read(), "pattern": pattern}
    # Workers keep what they loaded by its content: a path may hold another file tomorrow.
    key = hashlib.sha256(model["json"].encode() + model.get("ranks", b"") + model.get("pattern", "").encode())
    return model | {"key": key.hexdigest()}


def encoder(model: dict):
    """text -> ids, as tokenizers gives them without special tokens added.

    Where the same vocabulary is also given as ranks, plain texts go through
    tiktoken, which is several times faster and yields the same ids.
    """
    cache = worker_cache()
    if model["key"] in cache:
        return cache[model["key"]]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(model["json"])
    fast = None
    if "ranks" in model:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model["ranks"].splitlines())}
        fast = tiktoken.Encoding("ranks", pat_str=model["pattern"], mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if fast is not None and SPECIAL not in text and (text.isascii() or ord(max(text)) < PLAIN):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    cache[model["key"]] = encode
    return encode


def _pieces(shared, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def reduce_and_fit(sizes: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, how many in each)]) for `sizes` items of each length.

    From the longest length down, sets are fixed that provably dominate every
    other set with that item: an item nothing fits beside stays alone; the
    largest partner that fits is taken if it fills the bin exactly, if no two
    items fit instead of it, or if no three do and no two weigh more than it.
    Lengths are treated in bulk, as many copies as the rule holds for.  What is
    left goes best fit, longest first: the fullest open bin that has room.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in sizes.items():
        left[n] += c
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def take(bins: int, *items: tuple[int, int]) -> None:
        fixed.append((bins, list(items)))
        for n, m in items:
            left[n] -= bins * m

    def smallest(k: int, without: int) -> list[int]:
        """The k smallest items but for one of length `without`."""
        out: list[int] = []
        for n in np.flatnonzero(left):
            out += [int(n)] * int(min(k - len(out), left[n] - (n == without)))
            if len(out) >= k:
                break
        return out

    for j in range(capacity, 0, -1):
        while left[j]:
            room = capacity - j
            fit = np.flatnonzero(left[: room + 1])
            fit = fit[(fit != j) | (left[j] > 1)] if len(fit) else fit
            if not len(fit):
                take(int(left[j]), (j, 1))
                break
            i = int(fit[-1])
            least = smallest(3, j)
            sure = i == room or len(least) < 2 or sum(least[:2]) > room
            if not sure and (len(least) < 3 or sum(least) > room):
                pairs = fit[:, None] + fit[None, :]
                pairs[np.diag_indices(len(fit))] *= left[fit] - (fit == j) > 1
                sure = pairs[pairs <= room].max(initial=0) <= i
            if not sure:
                break
            if i == j:
                take(int(left[j] // 2), (j, 2))
            else:
                take(int(min(left[j], left[i])), (j, 1), (i, 1))
    bins: dict[int, list[list]] = {}  # by room left: [count, items]

    def put(room: int, count: int, items: list[tuple[int, int]]) -> None:
        if count:
            bins.setdefault(room, []).append([count, items])

    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                each = capacity // n
                put(capacity - each * n, c // each, [(n, each)])
                if c % each:
                    put(capacity - c % each * n, 1, [(n, c % each)])
                break
            count, items = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = min(room // n, c)
            used = min(count, c // each)
            put(room, count - used, items)
            put(room - each * n, used, [*items, (n, each)])
            c -= used * each
    return fixed + [(c, items) for groups in bins.values() for c, items in groups]


def _place(plan: list[tuple[int, list[tuple[int, int]]]]):
    """Rank of a piece among those of its length to sequence and offset."""
    taken: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for count, items in plan:
        at = 0
        for n, m in items:
            runs.setdefault(n, []).append((taken.get(n, 0), m, first, at))
            taken[n] = taken.get(n, 0) + count * m
            at += n * m
        first += count
    tables = {n: np.array(r, np.int64).T for n, r in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy() - 1
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                begin, each, base, at = tables[int(n)]
                k = np.searchsorted(begin, rank[own], "right") - 1
                ahead = rank[own] - begin[k]
                seq[own] = base[k] + ahead // each[k]
                off[own] = at[k] + ahead % each[k] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, model: dict, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end` (a null or empty text: `end` alone).
    Only documents longer than `capacity` are cut, the first piece being the
    shorter one.  Rows that repeat an id are packed each on its own, a null id
    is carried along, an empty table gives an empty one, and other columns of
    docs are ignored.

    Tokenised pieces (numbers only) are checkpointed once.  What the packing
    needs of them is how many there are of each length, at most `capacity`
    numbers; it is solved on the driver and gives, for each length, runs of
    ranks.  Pieces are ranked within their length in hash buckets, so that no
    task holds a whole length, and look their place up.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = checkpoint(docs.mapInArrow(_pieces(shared, capacity, end), schema))
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = reduce_and_fit(sizes, capacity)
    buckets = max(64, int(sum(sizes.values()) ** 0.5))
    keyed = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32"))
    keyed = keyed.withColumn("_b", F.floor((F.shiftrightunsigned("_h", 32) * buckets) / F.lit(2**32)).cast("int"))
    ranked = distributed_rank(keyed, ["length"], "_b", [F.shiftrightunsigned("_h", 32), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*pieces.columns, "_rank").mapInArrow(_place(plan), out)


by_value(__name__)
