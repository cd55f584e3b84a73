"""Packing by shortest-pack-first over the length histogram.

Documents become token ids with an end id and are cut into pieces of at most ``capacity`` ids. Only the histogram of
piece lengths comes to the driver: at most ``capacity`` numbers, whatever the corpus. There whole groups of equal
lengths are placed longest first, each into the shortest pack that has room, by counting packing patterns. Then each
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from tidewarden.llm.common import settle, text_of
from tidewarden.llm.wordwise import encoder

CAPACITY = 2048
END_ID = 1
SALTS = 1024   # a length's pieces are ranked in so many parts
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_name: str, text_name: str, capacity: int, tokenizer: str) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): a document's ids, the end id included, in pieces."""
    rows = docs.select(F.col(id_name).alias("_id"), text_of(text_name).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def cut(batches):
        words = encoder(tokenizer)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_py()) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s:4 * (s + capacity)]
                    at.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                names=["_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (number of packs, ((length, times), ...)) that hold each length as often as the histogram says.

    Lengths go longest first, each into the packs with most room left. Where none has room, as many packs are opened
    as the rest of that length needs.
    """
    open_packs: dict[int, list] = defaultdict(list)   # room left -> [number of packs, pattern]
    rooms: list[int] = []                             # a heap of the keys, largest first

    def put(room: int, n: int, pattern: tuple) -> None:
        if not open_packs[room]:
            heapq.heappush(rooms, -room)
        open_packs[room].append((n, pattern))

    def with_one(pattern: tuple, length: int) -> tuple:
        if pattern and pattern[-1][0] == length:
            return pattern[:-1] + ((length, pattern[-1][1] + 1),)
        return pattern + ((length, 1),)

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            while rooms and not open_packs[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                put(capacity, -(-left // (capacity // length)), ())
            room = -rooms[0]
            n, pattern = open_packs[room].pop()
            if not open_packs[room]:
                heapq.heappop(rooms)
            used = min(n, left)
            put(room - length, used, with_one(pattern, length))
            if n > used:
                put(room, n - used, pattern)
            left -= used
    return [(n, pattern) for room in sorted(open_packs) for n, pattern in open_packs[room] if pattern]


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """The ranks of each length, dealt to patterns: sorted by (length, first rank)."""
    rows, next_rank, base = [], defaultdict(int), 0
    for n, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, next_rank[length], times, offset, base))
            next_rank[length] += n * times
            offset += length * times
        base += n
    rows.sort()
    table = np.asarray(rows, dtype=np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "times", "offset", "sequence"))}


def pack(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text has the end id alone. Rows that repeat an id are documents of their own. Other columns are
    ignored; an empty table gives no rows. Which of several equally long pieces gets which place follows a hash and
    the order of (id, start, ids_crc32), so repeated runs agree.
    """
    cut = settle(pieces(docs, id_name, text_name, capacity, tokenizer)
                 .withColumn("_salt", F.pmod(F.xxhash64("_id", "start"), F.lit(SALTS)).cast("int")), "pack-pieces")
    counts = cut.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}   # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("_id", "start", "ids_crc32")
    ranked = cut.withColumn("_row", F.row_number().over(within)).join(base, ["length", "_salt"]) \
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)

    table = slots(shortest_pack_first(histogram, capacity))
    shift = max([0, *histogram.values()]).bit_length() + 1
    keys = (table["length"] << shift) + table["rank"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
        nth, slot = np.divmod(rank - table["rank"][at], table["times"][at])
        return pd.DataFrame({"sequence_id": table["sequence"][at] + nth, "offset": table["offset"][at] + slot * length})

    return ranked.withColumn("_place", place("length", "_rank")).select(
        F.col("_id").alias(id_name), "start", "length", "ids_crc32", "doc_tokens",
        "_place.sequence_id", "_place.offset")
