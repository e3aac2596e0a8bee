"""Best-fit packing of documents into training sequences.

Lengths are small whole numbers, so packing is planned on the histogram of lengths, whose size does not grow with the
corpus: pieces above a third of the capacity are matched, largest with the largest that fits, at most two in a
sequence; smaller ones, longest first, go to the smallest gap that holds them.  A plan entry places so many pieces of
one length into so many neighbouring sequences.  A piece finds its entry by its rank among pieces of its length, and
ranks are counted in hash buckets, so that no length meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankloom.session import shared_dir

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def encoder(ranks_file: str, pattern: str):
    """A byte-level BPE encoder from a file of ranks, one a process."""
    if ranks_file not in _encoders:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[ranks_file] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return _encoders[ranks_file]


def token_ids(text: str | None, ranks_file: str, pattern: str) -> np.ndarray:
    """The ids of the vocabulary's own tokenizer: its special token's string is that token, the rest byte-level BPE."""
    return encoder(ranks_file, pattern).encode_to_numpy(text or "", allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first piece may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(capacity: int, end_id: int, ranks_file: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, rows = batch.slice(a, 500), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(token_ids(text, ranks_file, pattern), end_id).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), *([own] if with_ids else [])))
                if rows:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows[0])])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's tokens, closed by end_id.

    A null or empty text has the end id alone; a text of any length is tokenised whole and only then cut; repeated rows give
    repeated pieces; an empty table gives none; other columns are ignored.
    """
    import public_tokenizers

    ranks_file = ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_pieces(capacity, end_id, ranks_file, public_tokenizers.PATTERN, with_ids), schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) entries that place every piece of the histogram."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit {capacity}")
        left[length] = n
    done, entries, bins = [0] * (capacity + 1), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def place(length: int, n: int, first_bin: int, offset: int) -> None:
        entries.append((length, done[length], n, first_bin, offset))
        done[length] += n
        left[length] -= n

    small = capacity // 3
    for length in range(capacity, small, -1):
        partner = min(length, capacity - length)
        while left[length]:
            while partner > small and (not left[partner] or partner == length and left[length] < 2):
                partner -= 1
            if partner <= small:
                n = left[length]
                place(length, n, bins, 0)
                gaps[capacity - length].append((bins, n))
            else:
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
                place(length, n, bins, 0)
                place(partner, n, bins, length)
                gaps[capacity - length - partner].append((bins, n))
            bins += n
    for length in range(small, 0, -1):
        gap = length
        while left[length]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            if not gaps[gap]:
                n = -(-left[length] // (capacity // length))
                gaps[capacity].append((bins, n))
                bins += n
            first, n = gaps[gap].pop()
            each = gap // length  # one after the other goes to the same sequence, whose gap is now the smallest
            whole, rest = divmod(left[length], each)
            whole = min(whole, n)
            rest = rest if whole < n else 0
            for k in range(each):
                if whole + (k < rest):
                    place(length, whole + (k < rest), first, capacity - gap + k * length)
            if whole:
                gaps[gap - each * length].append((first, whole))
            if rest:
                gaps[gap - rest * length].append((first + whole, 1))
            if n > whole + (rest > 0):
                gaps[gap].append((first + whole + (rest > 0), n - whole - (rest > 0)))
    return entries


def _placed(entries: list[tuple[int, int, int, int, int]], capacity: int):
    entries = sorted(entries)
    length, rank, _, first, offset = (np.array(x, np.int64) for x in zip(*entries)) if entries else [np.zeros(0, np.int64)] * 5
    start = np.searchsorted(length, np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            entry = np.zeros(len(own), np.int64)
            for x in np.unique(own):
                here = own == x
                a, b = start[x], start[x + 1]
                entry[here] = a + np.searchsorted(rank[a:b], at[here], "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(first[entry] + at - rank[entry]), pa.array(offset[entry])], ["row", "sequence_id", "offset"])

    return run


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut_pieces` (doc_id, piece, length, ids_crc32 and more) with sequence_id and offset: gapless from 0, within the capacity.

    Repeated rows are pieces of their own; null doc_ids are ordinary values; an empty table gives no rows.  Other columns
    come through whatever their names, but for sequence_id and offset, which the placement replaces.
    """
    spark = cut_pieces.sparkSession
    shared_dir(spark)
    cut_pieces = cut_pieces.drop("sequence_id", "offset")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    own = cut_pieces.select(F.col("length").cast("long").alias("length"), bucket.alias("bucket"), F.struct(*(F.col(f"`{c}`") for c in cut_pieces.columns)).alias("row")).checkpoint()
    counts = own.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {int(a): int(b) for a, b in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "bucket").orderBy("row.doc_id", "row.piece", "row.ids_crc32")
    ranked = own.join(counts, ["length", "bucket"]).select("length", (F.col("earlier") + F.row_number().over(inside) - 1).cast("long").alias("rank"), "row")
    placed = ranked.mapInArrow(_placed(plan(histogram, capacity), capacity), StructType([ranked.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    return placed.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_file: str | None = None) -> DataFrame:
    """The placement of every piece of `docs` (doc_id, text): see pieces() and pack()."""
    return pack(pieces(docs, capacity, end_id, ranks_file), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from packed pieces with ids; a sequence holds at most the capacity."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(placed, lambda x: x["ids"])).alias("ids"))
