"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference points taken from the data. A vector is described by its ``PREFIX`` nearest pivots in order. The
inverted lists are kept per set of ``SHARED`` pivots: two vectors meet in a list only if their prefixes share at least so many
pivots, so no pair is made from one pivot alone. Pairs that meet are verified by their cosine in double precision, each in
the list of their smallest shared pivots only, so that links can be counted where they are found.

Dense groups need no pairs. Vectors within half the link angle of a pivot are all linked with each other: they form
the pivot's ball and are counted. What links with one of a ball is within one and a half link angles of its pivot, so
a ball meets just these vectors. Lists and balls are cut into tiles of a fixed size; tasks see one tile at a time.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import settle
from tidewarden.llm.components import components

COSINE = 0.95
PIVOTS = 512          # at most; a bounded sample
SAMPLE = 4096         # vectors, by hash, that pivots are chosen from
APART = 0.7           # no two pivots have a larger cosine
PREFIX = 8
SHARED = 3
TILE = 1024
_HALF = np.cos(np.arccos(COSINE) / 2) + 1e-9
_NEAR = np.cos(np.arccos(COSINE) * 1.5) - 1e-9


def unit(values: list | None) -> np.ndarray | None:
    """The direction of a vector in double precision; None for one that links with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, float) + 0.0
    top = np.abs(x).max()
    if not np.isfinite(x).all() or not top:
        return None
    x /= top
    return x / np.sqrt((x * x).sum())


def _directions(batches):
    for batch in batches:
        ids, units, sizes = [], [], []
        for values in batch.column(1):
            values = values.as_py()
            x = unit(values)
            raw = None if x is None else (np.array(values, "<f8") + 0.0).tobytes()
            ids.append(None if raw is None else
                       int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 1)
            units.append(None if x is None else x.astype("<f8").tobytes())
            sizes.append(None if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(units, pa.binary()),
                                          pa.array(sizes, pa.int32())], names=["_id", "vid", "unit", "size"])


def choose(units: np.ndarray) -> np.ndarray:
    """Pivots among sampled vectors, in their order: none closer to an earlier one than ``APART``."""
    chosen: list[int] = []
    closest = np.full(len(units), -1.0)
    for i in range(len(units)):
        if closest[i] <= APART:
            chosen.append(i)
            if len(chosen) == PIVOTS:
                break
            closest = np.maximum(closest, units @ units[i])
    return units[chosen]



def _placed(pivots: dict[int, np.ndarray]):
    """Batches of classes -> (vid, ball, near, prefix, lists): the pivots' number within the vectors of its size."""
    triples = np.array(list(combinations(range(PREFIX), SHARED)))
    width = np.int64(PIVOTS + 1)

    def place(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            out = [[None] * batch.num_rows for _ in range(4)]
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(batch.column("unit").take(pa.array(rows)).to_pylist()), "<f8").reshape(len(rows), size)
                own = pivots.get(int(size), np.empty((0, size)))
                cosine = x @ own.T
                prefix = np.argsort(-cosine, axis=1, kind="stable")[:, :PREFIX]
                for k, row in enumerate(rows):
                    inside = np.flatnonzero(cosine[k] >= _HALF)
                    ball = int(inside[0]) if len(inside) else -1
                    out[0][row] = ball
                    out[1][row] = [int(p) for p in np.flatnonzero(cosine[k] >= _NEAR) if p != ball]
                    sorted_prefix = np.sort(prefix[k])
                    out[2][row] = sorted_prefix.tolist()
                    if ball >= 0:
                        out[3][row] = []
                    elif len(sorted_prefix) < PREFIX:   # too few pivots: the vectors of this size are one list
                        out[3][row] = [-int(size)]
                    else:
                        t = sorted_prefix[triples].astype(np.int64)
                        out[3][row] = ((t[:, 0] * width + t[:, 1]) * width + t[:, 2] + int(size) * width ** 3).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), batch.column("size"), pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())),
                 pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64()))],
                names=["vid", "size", "ball", "near", "prefix", "lists"])

    return place


def _first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of sorted prefixes: their ``SHARED`` smallest common pivots."""
    common = np.where((left[:, :, None] == right[:, None, :]).any(axis=2), left, np.iinfo(np.int64).max)
    return np.sort(common, axis=1)[:, :SHARED]


def _counted(batches):
    """Tiles -> (vid, n, root): links found in the tile, and the smallest vertex that they reach."""
    for batch in batches:
        vids, counts, roots = [], [], []
        for key, kind, members in zip(batch.column("list"), batch.column("kind"), batch.column("members")):
            members = members.as_py()
            vid = np.array([m["vid"] for m in members])
            order = np.argsort(vid)
            members, vid = [members[i] for i in order], vid[order]
            copies = np.array([m["copies"] for m in members])
            side = np.array([m["side"] for m in members])
            x = np.stack([np.frombuffer(m["unit"], "<f8") for m in members])
            a, b = np.nonzero(np.triu(x @ x.T >= COSINE, 1))
            if kind.as_py() != "inner":   # two blocks, or a ball and what is near it: only what crosses
                ok = side[a] != side[b]
                a, b = a[ok], b[ok]
            if kind.as_py() != "ball" and key.as_py() >= 0 and len(a):
                prefix = np.array([m["prefix"] for m in members], np.int64)
                width = np.int64(PIVOTS + 1)
                t = _first_shared(prefix[a], prefix[b])
                ok = (t[:, 0] * width + t[:, 1]) * width + t[:, 2] == key.as_py() % width ** 3
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            n = np.zeros(len(vid), np.int64)
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            label = np.arange(len(vid))
            while True:   # the smallest member of each component
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            hit = np.flatnonzero(n)
            vids.extend(vid[hit])
            counts.extend(n[hit])
            roots.extend(vid[label[hit]])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (vids, counts, roots)], names=["vid", "n", "root"])


def _tiles(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(list, kind, members) of rows (list, kind, tile, side, vid)."""
    full = rows.join(classes.select("vid", "unit", "copies", "prefix"), "vid")
    return full.groupBy("list", "kind", "tile").agg(
        F.collect_list(F.struct("vid", "side", "copies", "unit", "prefix")).alias("members")).select("list", "kind", "members")


def _list_tiles(placed: DataFrame) -> DataFrame:
    """Rows (list, kind, tile, side, vid) of the pivot lists; a list over ``TILE`` is cut into blocks that meet by twos."""
    rows = placed.select(F.explode("lists").alias("list"), "vid")
    sizes = rows.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").withColumn(
        "blocks", F.when(F.col("n") <= TILE, 1).otherwise(F.ceil(F.col("n") / (TILE // 2))).cast("int"))
    block = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    met = rows.join(sizes, "list").select("list", "vid", block.alias("own"),
                                          F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("list", F.when(F.col("own") == F.col("other"), "inner").otherwise("cross").alias("kind"), "own", "other", "vid") \
        .select("list", "kind", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
                F.col("own").alias("side"), "vid")


def _ball_tiles(placed: DataFrame) -> DataFrame:
    """Rows (list, kind, tile, side, vid): each block of a ball with each block of what is near it."""
    ball = F.concat_ws("-", "size", "ball")
    members = placed.where("ball >= 0").select(ball.alias("of"), "vid")
    near = placed.select("size", F.explode("near").alias("ball"), "vid").select(ball.alias("of"), "vid")
    parts = []
    counts = [rows.groupBy("of").agg(F.ceil(F.count("*") / (TILE // 2)).cast("int").alias(f"k{i}"))
              for i, rows in enumerate((members, near))]
    blocks = counts[0].join(counts[1], "of")
    for side, rows in enumerate((members, near)):
        own = F.pmod(F.xxhash64("vid"), F.col(f"k{side}")).cast("int")
        met = rows.join(blocks, "of").select("of", "vid", own.alias("own"), F.explode(
            F.sequence(F.lit(0), F.col(f"k{1 - side}") - 1)).alias("other"))
        pair = ("own", "other") if side == 0 else ("other", "own")
        parts.append(met.select(F.lit(-1).cast("long").alias("list"), F.lit("ball").alias("kind"),
                                F.concat_ws("-", "of", *pair).alias("tile"), F.lit(side).alias("side"), "vid"))
    return parts[0].union(parts[1])


def near_vectors(vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Vectors are linked when their cosine is at least ``COSINE``; vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are components of their own, and so do vectors of different sizes with
    each other. Rows with the same components are copies: each is linked with the others and counts as often in the
    links of its neighbours; they travel as one class (63-bit digests of the components). The component's id is the
    smallest id in it (nulls last); rows that repeat an id count each. Other columns are ignored; an empty table gives
    no rows. Recall of links at the threshold is above 0.99 for directions at random, and nearer to 1 above it.
    """
    rows = vectors.select(F.col(id_name).alias("_id"), F.col(vector_name).alias("_vector"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = settle(rows.mapInArrow(_directions, f"_id {kind}, vid long, unit binary, size int"), "vectors")
    full = found.where("vid IS NOT NULL")
    whole = settle(full.groupBy("vid").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"),
                                           F.first("unit").alias("unit"), F.first("size").alias("size")), "vector-classes")
    by_size: dict[int, list[bytes]] = {}
    for r in whole.select("vid", "size", "unit").orderBy("vid").limit(SAMPLE).collect():   # vid is a hash
        by_size.setdefault(r["size"], []).append(r["unit"])
    pivots = {size: choose(np.frombuffer(b"".join(units), "<f8").reshape(-1, size)) for size, units in by_size.items()}
    placed = settle(whole.select("vid", "unit", "size").mapInArrow(
        _placed(pivots), "vid long, size int, ball int, near array<int>, prefix array<int>, lists array<long>"), "vector-places")
    classes = whole.join(placed.select("vid", "prefix"), "vid")

    tiles = _tiles(_list_tiles(placed).union(_ball_tiles(placed)), classes)
    counted = settle(tiles.mapInArrow(_counted, "vid long, n long, root long"), "vector-links")
    inside = placed.where("ball >= 0").join(whole.select("vid", "copies"), "vid").select("vid", "copies", "size", "ball")
    # At most one row per pivot and vector size in the sample.
    balls = inside.groupBy("size", "ball").agg(F.sum("copies").alias("all"), F.min("vid").alias("root"))
    inside = inside.join(balls, ["size", "ball"]).select("vid", (F.col("all") - F.col("copies")).alias("n"), "root")
    links = counted.union(inside)
    n_links = links.groupBy("vid").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    linked = whole.select("vid", "rep", "copies").join(roots, F.col("vid") == F.col("id"), "left").select(
        "vid", "rep", "copies", F.coalesce("root", "vid").alias("root"))
    named = linked.groupBy("root").agg(F.min("rep").alias("component"))
    known = linked.join(named, "root").join(n_links, "vid", "left").select(
        "vid", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = full.select("_id", "vid").join(known, "vid").select("_id", "n", "component").unionByName(
        found.where("vid IS NULL").select("_id", F.lit(0).cast("long").alias("n"), F.col("_id").alias("component")))
    return out.select(F.col("_id").alias(id_name), F.col("n").alias("n_links"), F.col("component").alias("component_id"),
                      F.col("component").eqNullSafe(F.col("_id")).alias("kept"))
