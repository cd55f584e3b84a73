"""Spelling variants: a frequency-vector trie, searched depth first with a budget of one letter more and one letter less.

A word's frequency vector counts its letters by group. Two words that differ by one inserted, deleted or replaced letter
have vectors that differ by at most one more in one group and one less in one group. The trie orders words by length,
then by the count of one letter group after the other. A search for a word follows its own counts and may spend one
surplus and one deficit on the way down; the words of the leaves it reaches are verified.

The trie is dealt out by its nodes: each word stands as an entry in one node and asks in all nodes that its budget lets it
reach. A node of too many rows is parted by its next levels, and a leaf of too many rows into blocks of entries, each
asked by all words that reach the leaf; nothing is capped. A pair of words is met once: the longer word is the entry, or,
of two words of one length, the one that has more of the first group in which they differ.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import settle, text_of

#: Letter groups in the order of the trie's levels: frequent letters alone and first. Others go by their code point.
GROUPS = ("e", "t", "i", "a", "n", "r", "o", "s", "h", "l", "du", "cm", "gfw", "pyb", "vkjxqz")
OTHER_GROUPS = 5
LEVELS = len(GROUPS) + OTHER_GROUPS
FIRST = 1            # levels below the length by which the nodes are dealt out first
STEP = 2             # levels by which a node of too many rows is parted
NODE_ROWS = 100_000  # entries and questions of one node that one task takes at a time
LEAST_CHARS = 7
LEAST_COUNT = 2
FACTOR = 10          # a form has at least so many times the occurrences of the word
RARELY = 31          # one in so many runs of letters loses a letter
_CHUNK = 4096        # words that search at a time
_PAIRS = 1 << 18     # pairs verified at a time
_WIDE = 64           # longer words are verified one by one

_LEVEL = np.array([next((k for k, g in enumerate(GROUPS) if chr(c) in g), len(GROUPS) + c % OTHER_GROUPS) for c in range(256)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "node binary, asks boolean, word string, n long, more boolean, plus boolean, minus boolean"


def words_of(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """(word, n): words of whole texts with at least ``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences.

    A run of letters loses one letter where ``RARELY`` divides the crc32 of id and run, so that the words hold misspellings.
    """
    runs = docs.select(F.coalesce(F.col(id_name).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(
        text_of(text_name), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_CHARS},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_id", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    runs = runs.withColumn("_h", F.crc32(F.encode(F.concat("_id", F.lit(":"), "_run"), "UTF-8")))
    at = F.pmod("_h", F.length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    return runs.select(F.when(F.col("_h") % RARELY == 0, cut).otherwise(F.col("_run")).alias("word")) \
        .where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def vectors(words: list[str]) -> np.ndarray:
    """One row of ``LEVELS`` counts per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    level = np.where(codes < 256, _LEVEL[np.minimum(codes, 255)], len(GROUPS) + codes % OTHER_GROUPS)
    return np.bincount(owner * LEVELS + level, minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def _paths(of: np.ndarray) -> list[bytes]:
    """Node names: the counts on the way to it."""
    width = of.shape[1] * 4
    raw = np.ascontiguousarray(of, "<u4").tobytes()
    return [raw[k:k + width] for k in range(0, len(raw), width)]


def _down(want: np.ndarray, state: tuple, start: int, end: int):
    """The nodes at level ``end`` that questions at level ``start`` reach: (row, their counts, more, plus, minus)."""
    more, plus, minus = state
    row, seen = np.arange(len(want)), np.zeros((len(want), 0), np.int64)
    for level in range(start, end):
        own = want[row, level][:, None]
        may_plus = ~plus
        may_minus = plus & ~minus & ~more & (own[:, 0] > 0)   # of one length, the first difference is a surplus
        seen = np.concatenate([np.hstack([seen, own]), np.hstack([seen, own + 1])[may_plus], np.hstack([seen, own - 1])[may_minus]])
        row = np.concatenate([row, row[may_plus], row[may_minus]])
        more = np.concatenate([more, more[may_plus], more[may_minus]])
        plus, minus = (np.concatenate([plus, plus[may_plus] | True, plus[may_minus]]),
                       np.concatenate([minus, minus[may_plus], minus[may_minus] | True]))
    return row, seen, more, plus, minus


def _rows(paths, asks, words, n, more, plus, minus) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.binary()), pa.array(asks, pa.bool_()), words, n, *[pa.array(x, pa.bool_()) for x in (more, plus, minus)]],
        names=["node", "asks", "word", "n", "more", "plus", "minus"])


def _deal(batches):
    """Entries and questions of all words at the first nodes: length and ``FIRST`` counts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0).to_pylist()
        counts, length = vectors(words), np.array([len(w) for w in words])
        no = np.zeros(len(words), bool)
        yield _rows(_paths(np.hstack([length[:, None], counts[:, :FIRST]])), no, batch.column(0), batch.column(1), no, no, no)
        for more in (False, True):
            row, seen, *state = _down(counts, (no | more, no, no), 0, FIRST)
            take = pa.array(row)
            yield _rows(_paths(np.hstack([(length + more)[row][:, None], seen])), no[row] | True, batch.column(0).take(take),
                        batch.column(1).take(take), *state)


def _part(depth: int):
    """Moves the rows of nodes of ``depth`` levels ``STEP`` levels down."""
    def part(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = vectors(batch.column("word").to_pylist())
            asks, *state = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("asks", "more", "plus", "minus"))
            end = min(depth + STEP, LEVELS)
            entry, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
            row, seen, *then = _down(counts[asking], tuple(x[asking] for x in state), depth, end)
            take = np.concatenate([entry, asking[row]])
            tails = _paths(np.vstack([counts[entry, depth:end], seen]))
            heads = batch.column("node").take(pa.array(take)).to_pylist()
            yield _rows([h + t for h, t in zip(heads, tails)], asks[take], batch.column("word").take(pa.array(take)),
                        batch.column("n").take(pa.array(take)), *[np.concatenate([x[entry], y]) for x, y in zip(state, then)])
    return part


def is_near(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _verified(left: np.ndarray, right: np.ndarray, words: list[str], length: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which pairs are near; the right word is as long as the left one or one longer."""
    out = np.zeros(len(left), bool)
    wide = length[left] >= _WIDE
    for k in np.flatnonzero(wide):
        out[k] = is_near(words[left[k]], words[right[k]])
    at = np.flatnonzero(~wide)
    same = codes[left[at]] == codes[right[at]]
    equal = length[left[at]] == length[right[at]]
    near = np.count_nonzero(~same, axis=1) == 1
    # One letter longer: what follows the first difference must be equal one place on.
    longer = np.flatnonzero(~equal)
    first = np.argmin(same[longer], axis=1)   # of equal beginnings, the padding differs from the last letter
    moved = codes[left[at[longer]], :-1] == codes[right[at[longer]], 1:]
    near[longer] = (moved | (np.arange(moved.shape[1]) < first[:, None])).all(axis=1)
    out[at] = near
    return out


def _search(words: list[str], entry: np.ndarray, asking: np.ndarray, state: tuple, depth: int):
    """Pairs (asking word, entry) that are near, in chunks, below one node of ``depth`` levels.

    The questions of a chunk go down the trie together, level by level; each keeps what is left of its budget.
    """
    if not len(entry):
        return
    counts, length = vectors(words), np.array([len(w) for w in words])
    width = int(min(_WIDE, length.max())) + 2
    codes = np.zeros((len(words), width), np.uint16)
    short = [w if len(w) < width else "" for w in words]
    sizes = np.array([len(w) for w in short])
    flat = np.frombuffer("".join(short).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), sizes)
    codes[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat   # runs of letters end at U+00FF
    # The trie: entries in the order of their counts, and per level the keys (parent, count) of its nodes.
    entry = entry[np.lexsort(counts[entry, depth:].T[::-1])] if depth < LEVELS else entry
    base = int(counts.max()) + 3
    node, keys = np.zeros(len(entry), np.int64), []
    for level in range(depth, LEVELS):
        known, node = np.unique(node * base + counts[entry, level], return_inverse=True)
        keys.append(known)
    first = np.searchsorted(node, np.arange((node[-1] if len(node) else -1) + 2))
    more, plus, minus = state
    for lo in range(0, len(asking), _CHUNK):
        part = slice(lo, lo + _CHUNK)
        who, m, p, d = asking[part], more[part], plus[part], minus[part]
        at = np.zeros(len(who), np.int64)
        for level, known in zip(range(depth, LEVELS), keys):
            own = at * base + counts[who, level]
            may_plus, may_minus = ~p, p & ~d & ~m & (counts[who, level] > 0)
            key = np.concatenate([own, own[may_plus] + 1, own[may_minus] - 1])
            who, m = np.concatenate([who, who[may_plus], who[may_minus]]), np.concatenate([m, m[may_plus], m[may_minus]])
            p, d = (np.concatenate([p, p[may_plus] | True, p[may_minus]]), np.concatenate([d, d[may_plus], d[may_minus] | True]))
            at = np.searchsorted(known, key)
            hit = known[np.minimum(at, len(known) - 1)] == key
            who, m, p, d, at = who[hit], m[hit], p[hit], d[hit], at[hit]
        found = first[at + 1] - first[at]
        ends = np.cumsum(found)
        while len(found):   # the leaves' words, so many at a time
            upto = max(1, int(np.searchsorted(ends, (ends[0] - found[0]) + _PAIRS, side="right")))
            some = found[:upto]
            left = np.repeat(who[:upto], some)
            right = entry[np.repeat(first[at[:upto]], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)]
            ordered = np.repeat(p[:upto], some) | (left < right)   # equal counts meet from both sides: once is enough
            left, right = left[ordered], right[ordered]
            ok = _verified(left, right, words, length, codes)
            yield left[ok], right[ok]
            found, ends, who, p, at = found[upto:], ends[upto:], who[upto:], p[upto:], at[upto:]


def _near_in_node(table: pa.Table) -> pa.Table:
    """(word, n_near, form, form_n) of the words of one node: its near words here, and the most frequent of these."""
    asks, *state = (table.column(k).to_numpy() for k in ("asks", "more", "plus", "minus"))
    depth = len(table.column("node")[0].as_py()) // 4 - 1
    # A word asks at the node and may stand in it as well; both are one word here, in the order of code points.
    words = sorted(set(table.column("word").to_pylist()))
    place = {w: k for k, w in enumerate(words)}
    index = np.array([place[w] for w in table.column("word").to_pylist()])
    n = np.zeros(len(words), np.int64)
    n[index] = table.column("n").to_numpy()
    pairs = list(_search(words, index[~asks], index[asks], tuple(x[asks] for x in state), depth))
    left, right = (np.concatenate([p[k] for p in pairs] or [np.empty(0, np.int64)]).astype(np.int64) for k in (0, 1))
    word, other = np.concatenate([left, right]), np.concatenate([right, left])
    order = np.lexsort((other, -n[other], word))
    word, other = word[order], other[order]
    own, at, count = np.unique(word, return_index=True, return_counts=True)
    best = other[at]
    return pa.table({"word": pa.array([words[k] for k in own], pa.string()), "n_near": pa.array(count, pa.int64()),
                     "form": pa.array([words[k] for k in best], pa.string()), "form_n": pa.array(n[best], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of ``words`` (word, n) are near each, and the one with the largest n, as a
    struct (form_n, form); ties go to the smallest. Words without a near one are left out."""
    parts, rows, depth = [], settle(words.mapInArrow(_deal, _ROW), "spelling-nodes"), FIRST
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.count_if(~F.col("asks")).alias("entries")) \
            .where("entries > 0 AND entries < size")
        sized = rows.join(sizes, "node")
        large = sized.where(F.col("size") > NODE_ROWS).drop("size", "entries")
        parts.append(sized.where(F.col("size") <= NODE_ROWS).select("node", F.lit(0).alias("block"), *rows.columns[1:]))
        if depth == LEVELS or large.isEmpty():
            break
        rows = settle(large.mapInArrow(_part(depth), _ROW), "spelling-nodes")
        depth = min(depth + STEP, LEVELS)
    if depth == LEVELS:   # leaves of too many rows: blocks of entries, each asked by blocks of the others
        blocks = F.ceil(F.col("size") * 2 / NODE_ROWS).cast("long")
        own = F.pmod(F.xxhash64("word"), F.col("blocks"))
        parts.append(sized.where(F.col("size") > NODE_ROWS).withColumn("blocks", blocks).withColumn("own", own).withColumn(
            "other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
            "node", F.when(F.col("asks"), F.col("own") * F.col("blocks") + F.col("other"))
            .otherwise(F.col("other") * F.col("blocks") + F.col("own")).alias("block"), *rows.columns[1:]))
    rows = reduce(DataFrame.unionByName, parts)
    found = rows.groupBy("node", "block").applyInArrow(_near_in_node, "word string, n_near long, form string, form_n long")
    least = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("best")).select(
        "word", "n_near", F.struct((-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): the end of the chain of forms. Chains halve in each turn; as n grows along
    them by ``FACTOR``, they are short."""
    jumps = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = jumps.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        jumps = settle(jumps.join(on, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "spelling-roots")
        if jumps.where("moved").isEmpty():
            return jumps.select("word", "root")


def variants(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """One row per word of ``words_of``: (word, form, root, n, n_near, form_n).

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word with the
    largest n, the smallest of those in code-point order, if it has at least ``FACTOR`` times the word's n; else form and
    form_n are null. The root is where the forms end, the word itself if it has none. A null or empty text has no words;
    a null id counts as an empty text; rows that repeat count each; other columns are ignored; an empty table gives no
    rows.
    """
    words = settle(words_of(docs, id_name, text_name), "spelling-words")
    near = near_words(words)
    is_form = F.col("best.form_n") >= FACTOR * F.col("n")
    out = settle(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.form_n")).alias("form_n")), "spelling-forms")
    roots = last_forms(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
