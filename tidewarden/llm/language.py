"""Language identification by error-correcting output codes.

Each language has a codeword. One linear n-gram classifier per bit says on which side of that bit a text lies; all
bits are learned together from a bounded sample. A text gets the language whose codeword has the least loss over the
bits, each weighted by how well its classifier did for that language; a close second makes the text ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import one_of_each, sample_per_class, text_of

FEATURES = 1 << 13
SAMPLE_PER_LANGUAGE = 400    # texts learned from, of each language
STEPS = 120
EXHAUSTIVE = 5               # up to so many languages, all distinct bits are used
CLOSE = 0.15                 # a second language with a loss this close (relative) makes a text ambiguous
NONE = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngrams(text: str) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of the lower-cased text, letters only, as a unit vector of roots."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTER[np.minimum(codes, len(_LETTER) - 1)] | (codes >= len(_LETTER))
    a = np.where(letter, codes, 32).astype(np.uint32)
    one = a * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (a[1:] * np.uint32(0x85EBCA6B))
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (a[2:] * np.uint32(0x27D4EB2F))
    counts = np.zeros(FEATURES)
    for h in (one, two, three):
        counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(FEATURES - 1), minlength=FEATURES)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return (counts / norm if norm else counts).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: all bits that differ, or for many languages random ones."""
    if n <= EXHAUSTIVE:
        bits = [b for b in product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits or [(1,) * n]).T
    draw = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    codes = [draw.choice((-1, 1), size=(n, width)) for _ in range(50)]

    def nearest(code):   # the least distance of two codewords; a bit that is the same for all tells nothing
        apart = (width - code @ code.T) // 2 + width * np.eye(n, dtype=int)
        return apart.min() - width * (np.abs(code.sum(axis=0)) == n).any()
    return max(codes, key=nearest)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray       # languages x bits
    weights: np.ndarray    # (features + 1) x bits
    trust: np.ndarray      # languages x bits, each row adds up to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = np.clip(x @ self.weights[:-1] + self.weights[-1], -6, 6)
        return (np.exp(-margin[:, None, :] * self.code[None]) * self.trust[None]).sum(axis=2)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Logistic classifiers of all bits, by gradient steps with momentum; languages weigh alike."""
    code = codewords(len(languages))
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    target = code[y].astype(np.float32)
    weight = (1.0 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)[:, None] / len(languages)
    w = np.zeros((x1.shape[1], code.shape[1]), np.float32)
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        slope = -(x1.T @ (weight * target / (1 + np.exp(np.clip(target * (x1 @ w), -30, 30))))) + 1e-5 * w
        speed = 0.9 * speed - 5.0 * slope
        w += speed
    right = (x1 @ w) * target > 0
    trust = np.array([right[y == k].mean(axis=0) if (y == k).any() else np.ones(code.shape[1])
                      for k in range(len(languages))]) + 1e-3
    return Model(languages, code, w, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def learn(docs: DataFrame, usable: Column, id_name: str = "doc_id", text_name: str = "text", lang_name: str = "lang",
          most: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from at most ``most`` whole texts of each language among the usable rows; None if there are none.

    The sample is bounded by ``most`` times the number of languages, so its ids are broadcast and its features come
    to the driver; of rows that repeat an id in a language one is learned from.
    """
    picked = sample_per_class(docs.where(usable), id_name, lang_name, most).select(id_name, F.col(lang_name).alias("_lang"))
    rows = docs.where(usable & F.col(lang_name).isNotNull()).select(id_name, F.col(lang_name).alias("_lang"),
                                                                   text_of(text_name).alias("_text"))

    def describe(batches):
        for batch in batches:
            langs, vectors = [], []
            for lang, text in zip(batch.column(0), batch.column(1)):
                if has_letter(text := text.as_py()):
                    langs.append(lang.as_py())
                    vectors.append(ngrams(text).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())],
                                             names=["lang", "x"])

    sample = one_of_each(rows.join(F.broadcast(picked), [id_name, "_lang"], "left_semi"), [id_name, "_lang"], "_text")
    got = sample.select("_lang", "_text") \
        .mapInArrow(describe, "lang string, x binary").collect()
    got.sort()   # the order of partitions must not matter
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    x = np.stack([np.frombuffer(r.x, "<f4") for r in got])
    return fit(x, np.array([languages.index(r.lang) for r in got]), languages)


def predict(docs: DataFrame, model: Model | None, text_name: str = "text", as_name: str = "language") -> DataFrame:
    """``docs`` with one more column: (lang_pred, score, ambiguous) of the whole text.

    A text that is null or has no letter, or any text without a model, is ``und`` with score 0. The score is the
    language's share of exp(-loss) over all languages. All rows and columns stay.
    """
    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of(texts):
        import pandas as pd
        out = []
        for text in texts:
            if model is None or not text or not has_letter(text):
                out.append((NONE, 0.0, True))
                continue
            loss = model.losses(ngrams(text)[None])[0]
            order = np.argsort(loss, kind="stable")
            share = np.exp(loss[order[0]] - loss)
            close = len(order) > 1 and loss[order[1]] < loss[order[0]] * (1 + CLOSE)
            out.append((model.languages[order[0]], float(1 / share.sum()), bool(close)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(as_name, of(F.col(text_name)))
