"""Vector code compression: product codes whose codebooks are moved by active-entry Lloyd rounds, in whole numbers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of a few entries.
A round assigns each part to its nearest entry and moves each entry to the floor of its parts' mean. Between rounds each
part keeps its entry and the exact distance to it. A part whose entry did not move compares only the entries that did;
all other parts compare all entries. Equal distances go to the lower index, either way.

Each round writes one table: a row per vector, and per task one row more with the sums of its parts by entry, which
the next codebook is made of. A round's table is removed when the next one is written, so a lost executor costs at most
one round's tasks, and two tables exist at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import forget, settle_at
from tidewarden.operators.skew import attach

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 27     # of a scaled component: distances of vectors of 64 components stay below 2^63
_STATE = "id long, label {label}, x binary, code binary, distance binary, sums binary"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows to entries, exact."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):   # component by component: no rows x entries x components array
        step = x[:, k, None] - entries[None, :, k]
        out += step * step
    return out


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray | None = None, distance: np.ndarray | None = None,
           moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each row of one part position.

    With the last round's ``code`` and ``distance``, only rows whose entry is among ``moved`` are compared with all
    entries; the others with the moved ones. What did not move was farther, or as far with a higher index, and still is.
    """
    if code is None:
        all_of = distances(x, book)
        code = all_of.argmin(axis=1)   # the lowest index of the least
        return code, all_of[np.arange(len(x)), code]
    code, distance = code.copy(), distance.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, distance
    rescan = moved[code]
    rows = np.flatnonzero(rescan)
    if len(rows):
        code[rows], distance[rows] = assign(x[rows], book)
    rows = np.flatnonzero(~rescan)
    if len(rows):
        near = distances(x[rows], book[active])
        best = near.argmin(axis=1)
        least, entry = near[np.arange(len(rows)), best], active[best]
        better = (least < distance[rows]) | ((least == distance[rows]) & (entry < code[rows]))
        code[rows[better]], distance[rows[better]] = entry[better], least[better]
    return code, distance


def moved_book(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; entries without parts stay. All of shape parts x entries (x components)."""
    used = counts > 0
    out = book.copy()
    out[used] = sums[used] // counts[used][:, None]   # floors go down
    return out


def _vectors(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _round(batches, books: np.ndarray, before: np.ndarray | None, last: bool):
    """The rows with their entries under ``books``; ``before`` are the codebooks of the stored codes."""
    parts, entries, width = books.shape
    sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    names = ["id", "label", "x", "code", "distance", "sums"]
    schema = None
    for batch in batches:
        schema = batch.schema
        n = batch.num_rows
        if not n:
            continue
        x = _vectors(batch.column("x"), parts * width)
        code, distance = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
        if before is not None:
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            far = np.frombuffer(b"".join(batch.column("distance").to_pylist()), "<i8").reshape(n, parts)
            moved = (books != before).any(axis=2)
        for p in range(parts):
            own = x[:, p * width:(p + 1) * width]
            code[:, p], distance[:, p] = assign(own, books[p]) if before is None else \
                assign(own, books[p], old[:, p], far[:, p], moved[p])
            if not last:
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), batch.column("x"),
             pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()),
             pa.array([d.tobytes() for d in distance.astype("<i8")], pa.binary()), pa.nulls(n, pa.binary())], names=names)
    if schema is not None and not last:
        # The sums of all the task's parts: high and low halves, so that adding up many tasks' sums stays exact.
        own = b"".join(a.astype("<i8").tobytes() for a in (sums >> 32, sums & 0xFFFFFFFF, counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.nulls(1, schema.field("label").type), *[pa.nulls(1, pa.binary()) for _ in range(3)],
             pa.array([own], pa.binary())], names=names)


def _added(batches):
    """One row of the sums of all rows of the task."""
    total = None
    for batch in batches:
        for own in batch.column(0):
            own = np.frombuffer(own.as_py(), "<i8")
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _next_books(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """The moved entries; only sums come to the driver, one row per task of this small read."""
    got = state.select("sums").where("sums IS NOT NULL").coalesce(64).mapInArrow(_added, "sums binary").collect()
    if not got:
        return books
    total = [int(v) for v in sum(np.frombuffer(r.sums, "<i8").astype(object) for r in got)]
    size = books.size
    sums = np.array([(h << 32) + low for h, low in zip(total[:size], total[size:2 * size])], object).reshape(books.shape)
    counts = np.array(total[2 * size:], object).reshape(books.shape[:2])
    return moved_book(books.astype(object), sums, counts).astype(np.int64)


def _scaled(vectors: DataFrame, id_name: str, vec_name: str, label_name: str) -> DataFrame:
    """(id, label, x): integers of the usable vectors, as 32-bit ones in bytes."""
    kind = vectors.schema[label_name].dataType.simpleString()
    rows = vectors.select(F.col(id_name).cast("long").alias("id"), F.col(label_name).alias("label"),
                          F.col(vec_name).cast("array<double>").alias("v"))

    def scale(batches):
        for batch in batches:
            keep, out = [], []
            for k, v in enumerate(batch.column("v")):
                if not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = np.floor(SCALE * v.values.to_numpy())
                if np.isfinite(x).all() and np.abs(x).max() <= LARGEST:
                    keep.append(k)
                    out.append(x.astype("<i4").tobytes())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("label").take(take),
                                              pa.array(out, pa.binary())], names=["id", "label", "x"])

    return rows.mapInArrow(scale, f"id long, label {kind}, x binary")


def compress(vectors: DataFrame, id_name: str = "vec_id", vec_name: str = "embedding", label_name: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row per usable vector (id, label, code, distances; the last two as bytes, one entry and one 64-bit integer per part),
    and the final codebooks, parts x entries x components.

    A component x counts as floor(4096 x). Codebooks start as the parts of the vectors with the smallest ids (nulls last;
    rows of one id by the bytes of their integers); with fewer vectors there are as many entries. Left out are vectors that are
    null or empty or hold a null or non-finite component or, scaled, one beyond 2^27, and those that have another length
    than the first one kept or one that ``parts`` does not divide. An empty table gives no rows and no entries.
    """
    spark = vectors.sparkSession
    x, at = settle_at(_scaled(vectors, id_name, vec_name, label_name), "codes-vectors")
    fits = F.octet_length("x") % (4 * parts) == 0
    # At most ``entries`` rows: the codebooks' first entries.
    start = x.where(fits).orderBy(F.col("id").asc_nulls_last(), "x").limit(1).select(F.octet_length("x")).collect()
    if start:
        fits = F.octet_length("x") == start[0][0]
    first = x.where(fits).orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    width = start[0][0] // (4 * parts) if start else 1
    books = np.stack([np.frombuffer(r.x, "<i4") for r in first]).reshape(-1, parts, width).swapaxes(0, 1).astype(np.int64) \
        if first else np.zeros((parts, 0, width), np.int64)
    kind = _STATE.format(label=x.schema["label"].dataType.simpleString())
    state, before = x.where(fits), None
    if not first:
        return state.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("distance")), books

    for turn in range(rounds + 1):
        last = turn == rounds

        def work(batches, books=books, before=before, last=last):
            return _round(batches, books, before, last)

        state, now = settle_at(state.mapInArrow(work, kind), "codes-round")
        forget(spark, at)
        at, before = now, books
        if not last:
            books = _next_books(books, state)
            state = state.where("sums IS NULL")
    return state.select("id", "label", "code", "distance"), books


def book_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, id_name: str = "vec_id", vec_name: str = "embedding", label_name: str = "label") -> DataFrame:
    """One row per vector that ``compress`` keeps: (id, code, error, label_error, codebooks_sha256).

    ``code`` has two hex digits per part; ``error`` is the sum of the parts' squared distances, ``label_error`` that of all
    kept vectors of the label (nulls are one label). Rows that repeat an id count each; other columns are ignored.
    """
    rows, books = compress(vectors, id_name, vec_name, label_name)

    @F.pandas_udf("long")
    def added(distance):
        return distance.map(lambda d: int(np.frombuffer(d, "<i8").sum()))

    rows = rows.select("id", "label", F.lower(F.hex("code")).alias("code"), added("distance").alias("error"))
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows"))
    return attach(rows, labels, ["label"], "_rows", spread_by=["id"], hot_min_rows=1000).select(
        F.col("id").alias(id_name), "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
