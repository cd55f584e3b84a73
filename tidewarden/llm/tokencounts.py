"""Token counts of sections by offsets.

A document is encoded once and as a whole. The lengths of its tokens give their character spans, and an interval join
(two binary searches in the sorted section starts) finds the sections that each token touches. A token that crosses a
boundary is allocated by one rule: it belongs to the section that holds its first character.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import text_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OUTSIDE = -1


class Spans:
    """Character spans of the tokens of a text."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token; a token of part of a character touches that character."""
        ids = np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)
        end = np.cumsum(self.width[ids])
        start = end - self.width[ids]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if len(raw) == len(text):
            return start, end - 1
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[start], char[end - 1]


@lru_cache(maxsize=2)
def spans(path: str) -> Spans:
    """One per Python worker."""
    return Spans(path)


def lines(text: str) -> list[tuple[int, int]]:
    """The lines as spans; a line holds its newline, a text that ends in one has an empty last line."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return list(zip(starts, [*starts[1:], len(text)]))


def allocate(first: np.ndarray, last: np.ndarray, sections: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Per section: tokens allocated to it, and tokens it holds only a part of; and the tokens outside all.

    Sections are sorted and disjoint, gaps are allowed. A token that begins in a gap is outside.
    """
    bounds = np.asarray(sections, dtype=np.int64).reshape(-1, 2)
    full = bounds[bounds[:, 0] < bounds[:, 1]]          # empty sections get nothing
    where = np.flatnonzero(bounds[:, 0] < bounds[:, 1])
    n, n_cut = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), np.int64)
    if not len(full):
        return n, n_cut, len(first)
    own = np.searchsorted(full[:, 0], first, side="right") - 1
    inside = (own >= 0) & (first < full[own, 1])
    n[where] = np.bincount(own[inside], minlength=len(full))
    # Sections from the first to the last one a token touches; the token is cut where it does not lie in one alone.
    lo = np.searchsorted(full[:, 1], first, side="right")
    hi = np.searchsorted(full[:, 0], last, side="right") - 1
    whole = (lo == hi) & (full[np.minimum(lo, len(full) - 1), 0] <= first) \
        & (last < full[np.minimum(lo, len(full) - 1), 1])
    cut = np.flatnonzero(~whole & (lo <= hi))
    edges = np.zeros(len(full) + 1, np.int64)
    np.add.at(edges, lo[cut], 1)
    np.add.at(edges, hi[cut] + 1, -1)
    n_cut[where] = np.cumsum(edges)[:-1]
    return n, n_cut, int((~inside).sum())


def section_tokens(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text",
                   sections: Callable[[str], list[tuple[int, int]]] = lines, ranks: str = RANKS) -> DataFrame:
    """One row per document and section: (id, section, start, end, n_tokens, n_cut, doc_tokens).

    ``sections`` gives sorted disjoint character spans of a text. ``n_tokens`` are the tokens allocated to the
    section, ``n_cut`` the tokens that lie in it only in part. Tokens that begin in no section are counted in one
    more row, section -1, so that the rows of a document add up to ``doc_tokens``. A null text counts as empty: one
    empty line, no tokens. Repeated rows are counted each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_name).alias("_id"), text_of(text_name).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def count(batches):
        tokens = spans(ranks)
        for batch in batches:
            at, parts = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                found = sections(text)
                first, last = tokens(text)
                n, n_cut, outside = allocate(first, last, found)
                table = np.empty((len(found) + (outside > 0), 6), np.int64)
                table[:len(found), 0] = np.arange(len(found))
                table[:len(found), 1:3] = np.asarray(found, np.int64).reshape(-1, 2)
                table[:len(found), 3], table[:len(found), 4] = n, n_cut
                if outside:
                    table[-1, :5] = OUTSIDE, 0, len(text), outside, 0
                table[:, 5] = len(first)
                at.append(np.full(len(table), i))
                parts.append(table)
            if parts:
                whole = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(at)))] + [pa.array(whole[:, k]) for k in range(6)],
                    names=["_id", "section", "start", "end", "n_tokens", "n_cut", "doc_tokens"])

    return rows.mapInArrow(count, f"_id {kind}, section long, start long, end long, n_tokens long, n_cut long, "
                                  "doc_tokens long").withColumnRenamed("_id", id_name)
