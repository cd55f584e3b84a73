"""Near-duplicate texts by a chosen-path set similarity join.

Equal shingle sets become one class first. Each class has minwise tokens of its set. A tree branches classes from its
root: a node chooses one or two of the tokens (1/threshold of them on average) by a hash of its path, and a class goes
to one child per chosen token, named by the token's value. Similar sets share children again and again, others part
soon. Small nodes are compared, larger ones branch again, until no large node is left. Independent trees are repeated to
reach the recall wanted. The size of a node is that of its open pairs, those not known to be connected: before a large
node branches, its classes are linked within blocks, so a large group of near copies soon has few open pairs and ends.

Within a node classes are compared by odd sketches: the bits in which two of them differ are never more than the elements
in which their sets differ, so no link is lost, and hardly a pair under the threshold is left. A node does not give its
pairs but a forest of them, which grows with its classes. All of these are confirmed on the full sets; where one of a
forest fails, the node is looked at again, pair by pair.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import forget, settle, settle_at, text_of
from tidewarden.llm.components import components
from tidewarden.llm.exact import digest
from tidewarden.llm.shingles import mix, shingles

THRESHOLD = 85        # percent; linked when 100 * intersection >= threshold * union
TOKENS = 128          # minwise tokens of a set, 16 bits each
TREES = 16            # one tree finds about half of the links at 0.85 to 0.88 within a group that is 0.75 to 0.8 alike
RECALL = 0.998        # wanted of those links
LEVELS = 2            # branched before the first look at the sizes of nodes
MORE = 4              # branched between two later looks
SMALL = 2048          # a node with no more open pairs than so many unconnected classes have is compared
BLOCK = 256           # classes of a large node that are linked before it branches
BITS = 4              # of a sketch for each element of the set, up to twice as many
MOST_BITS = 1 << 17
SAFE = 4              # deviations over the estimated difference up to which a pair is taken for linked before it is confirmed
SURE = 3.5            # deviations under the threshold down to which linked sets have equal tokens
ROUNDS = 36           # after so many looks, what is still large is compared in blocks

_MULTIPLY = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(10_001, 10_001 + TOKENS, dtype=np.uint64))
_PART = 4096


def minwise(found: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash of the set under each of ``TOKENS`` hash functions."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _PART):
        part = found[at:at + _PART, None] * _MULTIPLY
        part += _ADD
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least).astype(np.uint16)


def sketch(found: np.ndarray) -> np.ndarray:
    """An odd sketch of the set: each element turns one bit over. One of half the length is the halves' exclusive or."""
    bits = min(MOST_BITS, max(256, 1 << (BITS * len(found) - 1).bit_length()))
    at = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


class Sketches:
    """Sketches of sets of ``n`` elements each, to be compared; indexing gives some of them in another order."""

    def __init__(self, n: np.ndarray, packed: np.ndarray):
        self.n, self.packed = n, packed
        self.width = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        self.at, self.words = np.empty(len(packed), np.int64), {}
        for width in np.unique(self.width).tolist():
            here = np.flatnonzero(self.width == width)
            self.at[here] = np.arange(len(here))
            self.words[width, width] = np.frombuffer(b"".join(packed[here]), "<u8").reshape(-1, width)

    def __getitem__(self, order: np.ndarray) -> Sketches:
        return Sketches(self.n[order], self.packed[order])

    def _folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.words:
            self.words[width, to] = _fold(self.words[width, width], to)
        return self.words[width, to]

    def differ(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits that differ, bits compared) of one and others."""
        width, widths = int(self.width[i]), self.width[others]
        differ, bits = np.empty(len(others), np.int64), np.empty(len(others), np.int64)
        for w in np.unique(widths).tolist():
            here, to = widths == w, min(w, width)
            rows = self._folded(w, to)[self.at[others[here]]] ^ self._folded(width, to)[self.at[i]]
            differ[here], bits[here] = np.bitwise_count(rows).sum(axis=1), 64 * to
        return differ, bits

    def most(self, i: int, others: np.ndarray) -> np.ndarray:
        """What the similarity of one and others is at most."""
        differ, _ = self.differ(i, others)
        both = self.n[i] + self.n[others]
        return (both - differ) / (both + differ)

    def judged(self, i: int, others: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(others, shares, sure) of those that may be linked: what their similarity is at most, and if they very likely are."""
        differ, bits = self.differ(i, others)
        both = self.n[i] + self.n[others]
        share = (both - differ) / (both + differ)
        near = share >= threshold / 100
        others, share, differ, bits, both = (x[near] for x in (others, share, differ, bits, both))
        different = -bits / 2 * np.log(np.maximum(1 - 2 * differ / bits, 1e-9))
        sure = different + SAFE * np.maximum(different, 1) / np.sqrt(bits) <= (100 - threshold) * both / (100 + threshold)
        return others, share, sure


def _digest(found: np.ndarray) -> int:
    """A vertex id of the set: 63 bits of a digest of all its shingles."""
    return int.from_bytes(hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=8).digest(), "little") >> 1


def maybe_from(threshold: int) -> float:
    """Least share of equal tokens that linked sets have, for measuring how many of them meet; ``SURE`` deviations are allowed."""
    t = threshold / 100
    return t - SURE * (t * (1 - t) / TOKENS) ** 0.5


def branch(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, levels: int,
           threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Children after ``levels`` levels: (node, row), for nodes of rows of ``tokens``."""
    second = np.uint64(int((100 / threshold - 1) * 2 ** 64))
    for _ in range(levels):
        turn = mix(node ^ np.uint64(0x5851F42D4C957F2D))
        places, rows, nodes = [(turn % np.uint64(TOKENS))], [row], [node]
        more = mix(turn) < second
        other = mix(turn[more] + np.uint64(1)) % np.uint64(TOKENS - 1) + np.uint64(1)   # never the same token twice
        places.append((turn[more] + other) % np.uint64(TOKENS))
        rows.append(row[more])
        nodes.append(node[more])
        place, row, node = (np.concatenate(x) for x in (places, rows, nodes))
        value = tokens[row, place.astype(np.int64)].astype(np.uint64)
        node = mix(node * np.uint64(3) + (place << np.uint64(16)) + value + np.uint64(1))
    return node, row


def _tokens(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, TOKENS)


def _signed(nodes: np.ndarray) -> pa.Array:
    return pa.array(nodes.view(np.int64))


def described(docs: DataFrame, id_name: str, text_name: str, digests: bool = False) -> DataFrame:
    """(id, sha, n_shingles, vid, tokens, sketch) of each document; one without words has no vid, tokens and sketch.

    ``sha`` is the digest of exact dedup, null unless ``digests``.
    """
    sha = digest(text_name) if digests else F.lit(None).cast("string")
    rows = docs.select(F.col(id_name).alias("_id"), text_of(text_name).alias("_text"), sha.alias("sha"))
    kind = rows.schema["_id"].dataType.simpleString()

    def describe(batches):
        for batch in batches:
            n, vid, tokens, sketches = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                n.append(len(found))
                vid.append(_digest(found) if len(found) else None)
                tokens.append(minwise(found).astype("<u2").tobytes() if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.string()), pa.array(n, pa.int64()), pa.array(vid, pa.int64()),
                 pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())],
                names=["_id", "sha", "n", "vid", "tokens", "sketch"])

    return rows.mapInArrow(describe, f"_id {kind}, sha string, n long, vid long, tokens binary, sketch binary")


def _roots(batches, threshold):
    for batch in batches:
        if batch.num_rows:
            tokens = _tokens(batch.column(1))
            trees = mix(np.arange(1, TREES + 1, dtype=np.uint64))
            node, row = branch(np.repeat(trees, batch.num_rows), np.tile(np.arange(batch.num_rows), TREES), tokens, LEVELS,
                               threshold)
            yield pa.RecordBatch.from_arrays([_signed(node), batch.column(0).take(pa.array(row))], names=["node", "vid"])


def _could_link(n, m, threshold):
    return 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)


def _binaries(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _nodes(batches, read=_tokens, named=False):
    """(vid, n, hub, tokens) of each node, from rows (node, vid, n, hub, tokens) that are sorted by node.

    The last column may be another one that ``read`` reads; the node itself comes first if ``named``.
    """
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        node, *columns = (batch.column(k).to_numpy() for k in range(4))
        columns.append(read(batch.column(4)))
        if named:
            columns.insert(0, node)
        cuts = (np.flatnonzero(node[1:] != node[:-1]) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(node)]):
            if held and node[lo] != last:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            last = node[lo]
            held.append([c[lo:hi] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _shares(tokens, i, others):
    return tokens.most(i, others) if isinstance(tokens, Sketches) else (tokens[others] == tokens[i]).mean(axis=1)


def _open_pairs(n, hub, tokens, least, threshold):
    """(i, others, shares): the pairs that are not known to be connected, with a share of at least ``least``.

    The share is that of equal tokens, or the most that sketches allow. Classes are taken by their component, the largest
    component last, so that only open pairs are compared.
    """
    _, component, count = np.unique(hub, return_inverse=True, return_counts=True)
    order = np.lexsort((component, count[component]))
    n, tokens, component = n[order], tokens[order], component[order]
    ends = np.flatnonzero(np.append(component[1:] != component[:-1], True)) + 1
    start = 0
    for end in ends[:-1]:
        for i in range(start, end):
            others = end + np.flatnonzero(_could_link(n[i], n[end:], threshold))
            share = _shares(tokens, i, others)
            near = share >= least
            if near.any():
                yield order[i], order[others[near]], share[near]
        start = end


def forest(vid, n, hub, sketches, threshold):
    """Edges (i, j, share, alone) between classes that are not known to be connected.

    Classes that very likely link are connected by a forest. Of the other pairs that may link, between two trees of it the
    best one is given, ``alone`` if there is no other. So if all edges are links that are not alone, every two linked
    classes are connected. The forest is grown breadth first in the order of ``vid``, so that it is alike in many nodes.
    """
    _, component, count = np.unique(hub, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(component, kind="stable"), np.cumsum(count)[:-1])
    biggest = component == count.argmax() if count.max() > 1 else np.zeros(len(vid), bool)
    rest = np.lexsort((vid, biggest))    # the largest component comes last and need not look for others
    tree = np.full(len(vid), -1)
    grown, maybe = [], []
    for at in range(len(vid)):
        if not len(rest):
            break
        queue = deque(members[component[rest[0]]].tolist())
        tree[members[component[rest[0]]]] = at
        rest = rest[tree[rest] < 0]
        while queue and len(rest):
            i = queue.popleft()
            others = rest[_could_link(n[i], n[rest], threshold)]
            if not len(others):
                continue
            others, share, sure = sketches.judged(i, others, threshold)
            if not sure.all():
                maybe.append((np.full(np.count_nonzero(~sure), i), others[~sure], share[~sure]))
            if sure.any():
                found, share = others[sure], share[sure]
                by = np.lexsort((-share, component[found]))   # one edge to each component
                by = np.sort(by[np.append(True, np.diff(component[found[by]]) != 0)])
                grown.append((np.full(len(by), i), found[by], share[by], np.zeros(len(by), bool)))
                for j in found[by].tolist():
                    tree[members[component[j]]] = at
                    queue.extend(members[component[j]].tolist())
                rest = rest[tree[rest] < 0]
    if maybe:
        i, j, share = (np.concatenate(x) for x in zip(*maybe))
        low, high = np.minimum(tree[i], tree[j]), np.maximum(tree[i], tree[j])
        by = np.lexsort((-share, high, low))
        by = by[low[by] != high[by]]
        if len(by):
            first = np.flatnonzero(np.append(True, (np.diff(low[by]) != 0) | (np.diff(high[by]) != 0)))
            alone = np.diff(np.append(first, len(by))) == 1
            by = by[first]
            grown.append((i[by], j[by], share[by], alone))
    return [np.concatenate(x) for x in zip(*grown)] if grown else None


_EDGE = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64()), ("alone", pa.bool_())])
EDGE = "node long, a long, b long, share double, alone boolean"


def _edges(found):
    """Batches of ``EDGE`` of the arrays in ``found``."""
    held, rows = [], 0
    for arrays in found:
        held.append(arrays)
        rows += len(arrays[0])
        if rows > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=_EDGE)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=_EDGE)


def _forests(batches, threshold):
    """The forest of each node."""
    def found():
        for node, vid, n, hub, packed in _nodes(batches, _binaries, named=True):
            edges = forest(vid, n, hub, Sketches(n, packed), threshold)
            if edges is not None:
                i, j, share, alone = edges
                yield node[i], np.minimum(vid[i], vid[j]), np.maximum(vid[i], vid[j]), share, alone
    yield from _edges(found())


def _exhaustive(batches, threshold):
    """All pairs within each node that may be linked and are not known to be connected."""
    def found():
        for node, vid, n, hub, packed in _nodes(batches, _binaries, named=True):
            for i, others, share in _open_pairs(n, hub, Sketches(n, packed), threshold / 100, threshold):
                yield node[others], np.minimum(vid[i], vid[others]), np.maximum(vid[i], vid[others]), share, np.ones(len(others), bool)
    yield from _edges(found())


def _deeper(batches, threshold):
    """(node, vid) of the children of rows (node, vid, tokens)."""
    for batch in batches:
        if batch.num_rows:
            node, vid = (batch.column(k).to_numpy() for k in (0, 1))
            child, row = branch(node.view(np.uint64), np.arange(len(node)), _tokens(batch.column(2)), MORE, threshold)
            yield pa.RecordBatch.from_arrays([_signed(child), pa.array(vid[row])], names=["node", "vid"])


def _nearer(links: DataFrame) -> DataFrame:
    """(id, root): for each vertex in ``links`` the smallest vertex at most two links away."""
    ends = links.union(links.select("b", "a"))
    one = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root"))
    two = ends.join(one, F.col("b") == F.col("id")).select("a", "root").union(one)
    return two.groupBy("a").agg(F.min("root").alias("root")).withColumnRenamed("a", "id")


class _Kept:
    """Tables of the rounds by name; a new one of the same name removes the old one, which nothing may read any more."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        out, path = settle_at(df, f"near-{name}")
        self.forget(name)
        self.paths[name] = path
        return out

    def forget(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                forget(self.spark, self.paths.pop(name))


def _opened(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """(node, vid, hub, size, open) of rows (node, vid) in nodes with open pairs, those not known to be connected.

    ``hub`` is the smallest vertex that the class is known to be connected with.
    """
    if known is None:
        rows = rows.select("node", "vid", F.col("vid").alias("hub"))
    else:
        rows = rows.join(known, F.col("vid") == F.col("id"), "left").select("node", "vid", F.coalesce("root", "vid").alias("hub"))
    sizes = rows.groupBy("node", "hub").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.sum("n").alias("size"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("open"))
    return rows.join(sizes.where("open > 0"), "node")


def _compared(rows: DataFrame, classes: DataFrame, how, threshold: int) -> DataFrame:
    """``how`` over the nodes of rows (node, vid, hub)."""
    return rows.select("node", "vid", "hub").join(classes.select("vid", "n", "sketch"), "vid") \
        .select("node", "vid", "n", "hub", "sketch").repartition("node").sortWithinPartitions("node") \
        .mapInArrow(partial(how, threshold=threshold), EDGE)


def candidates(nodes: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int,
               kept: _Kept) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``nodes``: the ``EDGE`` rows of all that were compared, their rows (node, vid), and the links (a, b) that were
    confirmed on the way."""
    edges, looked, links, known = [], [], [], None
    least_open = SMALL * (SMALL - 1) // 2
    for turn in range(ROUNDS):
        small = F.col("open") <= least_open
        large, looks = nodes.where(~small), [nodes.where(small).select("node", "vid", "hub")]
        if not large.isEmpty():
            # What is likely linked is confirmed first, in blocks. It joins groups of near copies, so that few of their
            # pairs are still open.
            block = F.pmod(F.xxhash64("vid", "node"), F.ceil(F.col("size") / BLOCK))
            near = _compared(large.withColumn("node", F.xxhash64("node", block)), classes, _forests, threshold)
            near = kept.settle(near.select("a", "b").distinct(), "nearest")
            sure = settle(confirmed(near, texts, threshold), "near-sure")
            if not sure.isEmpty():
                links.append(sure)
                linked = sure if known is None else sure.union(known.select(F.col("id").alias("a"), F.col("root").alias("b")))
                known = kept.settle(_nearer(linked), "known")
                opened = kept.settle(_opened(large.select("node", "vid"), known), f"large-{turn}")
                large = opened.where(~small)
                looks.append(opened.where(small).select("node", "vid", "hub"))
        if turn == ROUNDS - 1:   # the rest, exactly: each two blocks of a node meet
            blocks = F.ceil(F.col("size") / (SMALL // 2))
            met = large.withColumn("own", F.pmod(F.xxhash64("vid"), blocks)).withColumn(
                "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            looks.append(met.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
                         .select("node", "vid", "hub"))
        looked += looks
        edges.append(kept.settle(_compared(reduce(DataFrame.union, looks), classes, _forests, threshold), f"edges-{turn}"))
        if turn == ROUNDS - 1 or large.isEmpty():
            break
        children = kept.settle(large.select("node", "vid").join(classes, "vid").select("node", "vid", "tokens")
                               .mapInArrow(partial(_deeper, threshold=threshold), "node long, vid long"), "nodes")
        nodes = kept.settle(_opened(children, known), f"shared-{turn + 1}")
        kept.forget("nodes")
    kept.forget("nearest", "known")
    return (reduce(DataFrame.union, edges), reduce(DataFrame.union, looked).select("node", "vid"),
            reduce(DataFrame.union, links) if links else edges[0].select("a", "b").where("false"))


def _confirm(batches, threshold):
    for batch in batches:
        a, b = [], []
        last, known = None, None
        for u, v, left, right in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
            if (left := left.as_py()) != last:
                last, known = left, shingles(left)
            other = shingles(right.as_py())
            both = len(np.intersect1d(known, other, assume_unique=True))
            if 100 * both >= threshold * (len(known) + len(other) - both):
                a.append(u.as_py())
                b.append(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets; ``texts`` has one text per vertex."""
    # Only texts that a pair asks for move.
    left, right = (texts.join(pairs.select(F.col(k).alias("vid")).distinct(), "vid", "left_semi").select(
        F.col("vid").alias(k), F.col("text").alias(name)) for k, name in (("a", "_left"), ("b", "_right")))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_left", "_right") \
        .mapInArrow(partial(_confirm, threshold=threshold), "a long, b long")


def _vertex_texts(batches):
    for batch in batches:
        vids = [_digest(shingles(t.as_py())) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(vids, pa.int64()), batch.column(0)], names=["vid", "text"])


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not known to be connected, with the roots of both sides as ``ra`` and ``rb``."""
    left = roots.select(F.col("id").alias("a"), F.col("root").alias("_a"))
    right = roots.select(F.col("id").alias("b"), F.col("root").alias("_b"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select(
        *pairs.columns, F.coalesce("_a", "a").alias("ra"), F.coalesce("_b", "b").alias("rb")).where("ra <> rb")


def roots_of(classes: DataFrame, docs: DataFrame, id_name: str, text_name: str, threshold: int) -> DataFrame:
    """(id, root) of each vertex that is linked with another one."""
    kept = _Kept(classes.sparkSession)
    rows = kept.settle(classes.select("vid", "tokens").mapInArrow(partial(_roots, threshold=threshold), "node long, vid long"), "nodes")
    nodes = kept.settle(_opened(rows, None), "shared-0")
    kept.forget("nodes")
    wanted = nodes.select("vid").distinct()
    ids = classes.join(wanted, "vid", "left_semi").select("rep").distinct()
    # One row of each class is fetched; a repeated id may fetch more, so the vertex is found again and kept once.
    texts = docs.select(F.col(id_name).alias("_id"), text_of(text_name).alias("text")).join(
        ids, F.col("_id").eqNullSafe(F.col("rep")), "left_semi").select("text") \
        .mapInArrow(_vertex_texts, "vid long, text string")
    texts = kept.settle(texts.groupBy("vid").agg(F.first("text").alias("text")), "texts")
    edges, looked, links = candidates(nodes, classes, texts, threshold, kept)
    maybe = kept.settle(edges.groupBy("a", "b").agg(F.max("share").alias("share")), "candidates")
    # First the best candidate of each component; then all that would still join two.
    for best_only in (True, False):
        rest = kept.settle(_apart(maybe, components(links, turns=2)), "apart")
        if best_only:
            ends = rest.select(F.col("ra").alias("v"), "a", "b", "share").union(rest.select("rb", "a", "b", "share"))
            best = ends.groupBy("v").agg(F.max(F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
            rest = kept.settle(best, "best")
        links = settle(links.union(confirmed(rest, texts, threshold)), "near-links")
    roots = settle(components(links), "near-linked")
    # Where an edge that stood for others was no link, the pairs of the node that are still apart are taken one by one.
    again = kept.settle(_apart(edges.where("not alone"), roots).select("node").distinct(), "again")
    if not again.isEmpty():
        rows = looked.join(again, "node", "left_semi").distinct().join(roots, F.col("vid") == F.col("id"), "left").select(
            "node", "vid", F.coalesce("root", "vid").alias("hub"))
        more = _compared(rows, classes, _exhaustive, threshold).select("a", "b").distinct().join(maybe, ["a", "b"], "left_anti")
        more = settle(confirmed(kept.settle(more, "more"), texts, threshold), "near-more")
        if not more.isEmpty():
            roots = settle(components(links.union(more)), "near-linked")
    kept.forget(*kept.paths)
    return roots


def _judged(docs: DataFrame, id_name: str, text_name: str, threshold: int, digests: bool = False) -> DataFrame:
    """(_id, sha, n, root, component) of each document; without words, root is null and the component its own id."""
    rows = settle(described(docs, id_name, text_name, digests), "near-described")
    full = rows.where("vid IS NOT NULL")
    classes = settle(full.groupBy("vid").agg(F.min("_id").alias("rep"), F.first("n").alias("n"),
                                             F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "near-classes")
    roots = roots_of(classes, docs, id_name, text_name, threshold)
    linked = classes.select("vid", "rep").join(roots, F.col("vid") == F.col("id"), "left").select(
        "vid", "rep", F.coalesce("root", "vid").alias("root"))
    named = linked.groupBy("root").agg(F.min("rep").alias("component"))
    # A class of one row that is linked with nothing needs no join; the others are few.
    component = linked.join(named, "root").select("vid", "root", "component")
    return full.select("_id", "sha", "n", "vid").join(component, "vid", "left").select(
        "_id", "sha", "n", "root", "component").unionByName(
        rows.where("vid IS NULL").select("_id", "sha", "n", F.lit(None).cast("long").alias("root"),
                                         F.col("_id").alias("component")))


def near_duplicates(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text",
                    threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    Two texts are linked when their sets of 5-word shingles overlap by at least ``threshold`` percent of their union;
    sets are of 64-bit hashes. A null text and one without words have the empty set and are linked with nothing: each
    is a component of its own. The component's id is the smallest id in it (nulls last), and the documents with that
    id are kept; rows that repeat an id count each. Other columns are ignored; an empty table gives no rows.
    """
    out = _judged(docs, id_name, text_name, threshold)
    return out.select(F.col("_id").alias(id_name), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("component").eqNullSafe(F.col("_id")).alias("kept"))


def survivors(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, text_sha256) of one document of each component of ``near_duplicates``, also where ids repeat.

    It has the smallest id of the component, and the smallest digest of those with this id.
    """
    kept = _judged(docs, id_name, text_name, threshold, digests=True).where(F.col("component").eqNullSafe(F.col("_id")))
    one = kept.where("root IS NOT NULL").groupBy("root").agg(F.first("_id").alias("_id"), F.min("sha").alias("sha"))
    return one.select("_id", "sha").union(kept.where("root IS NULL").select("_id", "sha")).select(
        F.col("_id").alias(id_name), F.col("sha").alias("text_sha256"))
