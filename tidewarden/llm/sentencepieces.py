"""Exact SentencePiece BPE by backtracking over longest matches.

Instead of merging a text step by step, an Aho-Corasick automaton lists the pieces that start at each position, and
the encoding is built left to right from the longest ones. A piece may follow another only if merging their joined
text again gives just these two. A position from which no piece can go on is marked as failed and never entered again.
A sequence whose neighbours all agree in this way is what merging the whole text gives, so the result is exact.

For models of type BPE with byte fallback, identity normalization and a dummy prefix, whose pieces never join a blank
to what stands before it (``piece_bpe_32k.model``). Runs that start with blanks are then independent and are cached.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from tidewarden.llm.common import text_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
CACHED = 300_000      # runs, parts of runs, and pairs of pieces; a full cache is emptied, which costs time and changes nothing
SLICE = 512           # documents of one output batch


def _le(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Found(dict):
    """Ids by text, found when first asked for."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        ids = self[text] = self.find(text)
        return ids


class PieceCodec:
    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.texts: list[bytes] = []          # of each id, blanks as spaces
        self.byte_of: dict[int, int] = {}
        self.matches = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.texts.append(bytes([self.byte_of[i]]))
            elif model.is_control(i):
                self.texts.append(b"")
            elif model.is_unknown(i):
                self.texts.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.matches.add_word(piece, len(piece))
                self.texts.append(piece.replace(BLANK, " ").encode())
        self.matches.make_automaton()
        self.begin, self.end = _le([model.bos_id()]), _le([model.eos_id()])
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.joins = {two for piece in self.ids for two in zip(piece, piece[1:])}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts = _Found(self._part)   # by the text between boundaries that no piece crosses
        self.runs = _Found(lambda run: self._run(BLANK + run))   # by what follows the first blank

    def merged(self, text: str) -> list[str]:
        """What merging does to a short text: the best-scored pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives just these two (with an empty left: just the right one)."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(left + right) == [x for x in key if x]
        return got

    def pieces(self, text: str) -> list[str]:
        """The encoding of a text of known characters, as pieces."""
        n = len(text)
        pairs, agree = self.pairs, self.agree
        out, left = [], ""
        for last, length in self.matches.iter_long(text):   # mostly the first try, all longest, holds
            right = text[last + 1 - length:last + 1]
            if not pairs.get((left, right)) and not agree(left, right):
                break
            out.append(right)
            left = right
        if sum(map(len, out)) == n:
            return out

        lengths = [[1] for _ in range(n)]   # a character may be no piece of its own
        for last, length in self.matches.iter(text):
            if length > 1:
                lengths[last + 1 - length].append(length)
        open_ends = bytearray(b"\x01") * (n + 1)   # the field of positions that have not failed
        out, tried = [], []
        pos, k = 0, len(lengths[0]) - 1
        while pos < n:
            left = out[-1] if out else ""
            at = lengths[pos]
            while k >= 0:
                end = pos + at[k]
                if open_ends[end]:
                    right = text[pos:end]
                    if pairs.get((left, right)) or agree(left, right):
                        break
                k -= 1
            if k >= 0:
                out.append(right)
                tried.append(k)
                pos = end
                k = len(lengths[pos]) - 1 if pos < n else -1
            else:
                open_ends[pos] = 0
                pos -= len(out.pop())
                k = tried.pop() - 1
        return out

    def _run(self, run: str) -> bytes:
        joins, start, parts = self.joins, 0, []
        for i, two in enumerate(zip(run, run[1:]), 1):   # no piece crosses here: the sides are independent
            if two not in joins:
                parts.append(self.parts[run[start:i]])
                start = i
        parts.append(self.parts[run[start:]])
        return b"".join(parts)

    def _part(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(part):
            i = self.ids.get(piece)
            if i is None:
                ids.extend(self.byte_id[b] for b in piece.encode())
            else:
                ids.append(i)
        return _le(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, begin and end included."""
        if not text:
            return self.begin + self.end
        text = text.replace(BLANK, " ")
        runs = text.split(" ")
        if "" in runs:
            runs = [r[1:] for r in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK))]
        return b"".join([self.begin, *map(self.runs.__getitem__, runs), self.end])

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        parts = list(map(self.texts.__getitem__, ids))
        for i, part in enumerate(parts):
            if part:   # the first piece that has a text loses the dummy prefix
                parts[i] = part[1:] if part[:1] == b" " and ids[i] in self.piece_ids else part
                break
        joined = b"".join(parts)
        try:
            return joined.decode()
        except UnicodeDecodeError:   # byte pieces that are no characters: each such byte is one replacement mark
            return "".join(self._bytes_text(joined))

    @property
    def piece_ids(self) -> frozenset[int]:
        if not hasattr(self, "_piece_ids"):
            self._piece_ids = frozenset(self.ids.values())
        return self._piece_ids

    @staticmethod
    def _bytes_text(raw: bytes):
        at = 0
        while at < len(raw):
            for width in (1, 2, 3, 4):
                try:
                    yield raw[at:at + width].decode()
                except UnicodeDecodeError:
                    continue
                at += width
                break
            else:
                yield "�"
                at += 1


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per Python worker, so its caches serve all tasks there."""
    return PieceCodec(path)


def encode(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: (id, ids, decoded): the whole text's ids and what they decode to.

    ``ids`` is binary, little-endian unsigned 32-bit integers with begin and end ids. A null text counts as empty; it
    has these two ids and decodes to an empty text. Repeated rows come out as often; other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_name).alias("_id"), text_of(text_name).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def both(batches):
        pieces = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [pieces.encode(t.as_py()) for t in part.column(1)]
                texts = [pieces.decode(np.frombuffer(i, dtype="<u4").tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                    names=["_id", "ids", "decoded"])

    return rows.mapInArrow(both, f"_id {kind}, ids binary, decoded string").withColumnRenamed("_id", id_name)
