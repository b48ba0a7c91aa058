"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram is bound by multiplying its letters' vectors,
each permuted (rolled) by its place.  A document bundles (adds) the vectors of its n-grams, a language
those of its documents; the language whose prototype has the largest cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import bounded_sample, held_out, slices, small_batches, table

UNDETERMINED = "und"
#: Documents a language learns from, about; further ones hardly move a prototype.
SAMPLE = 1500
DIMENSIONS, GRAM = 512, 3
#: Characters of text bundled together: bounds the n-grams whose vectors are in memory at once.
STEP_CHARS = 1 << 18
#: A shorter text counts as so many of them, which bounds the texts; n-grams are multiplied BLOCK at a time.
LEAST_CHARS, BLOCK = 256, 8192


@dataclass
class Profiles:
    """Unit prototypes, a row per language in the order of `languages`."""

    languages: list[str] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS), np.float32))


@lru_cache(1)
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(1 << 16)
def _letter_vector(letter: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([letter, 5]).integers(0, 2, dimensions, np.int8) * np.int8(2) - np.int8(1)


def _gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """A row per n-gram code: the product of its letters' vectors, rolled by their places."""
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(GRAM):
        letters, at = np.unique((grams >> np.uint64(21 * place)) & np.uint64((1 << 21) - 1), return_inverse=True)
        rolled = np.stack([np.roll(_letter_vector(int(x), dimensions), place) for x in letters])
        out *= rolled[at]
    return out.astype(np.float32)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts.  Runs of other characters become one boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    points = points[(points != 0) | (np.concatenate(([1], points[:-1])) != 0)].astype(np.uint64)
    if len(points) < GRAM or not points.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.zeros(len(points) - GRAM + 1, np.uint64)
    for place in range(GRAM):
        codes |= points[place : place + len(codes)] << np.uint64(21 * place)
    return np.unique(codes, return_counts=True)


def bundle(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A vector per text: the sum over its n-grams.  Zero for a text without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    lengths = np.array([max(len(t), LEAST_CHARS) if isinstance(t, str) else LEAST_CHARS for t in texts])
    for a, b in slices(lengths, STEP_CHARS):
        own = [_grams(t if isinstance(t, str) else "") for t in texts[a:b]]
        grams, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        rows = np.repeat(np.arange(b - a), [len(g) for g, _ in own])[order]
        at, counts = at[order], np.concatenate([c for _, c in own])[order]
        for lo in range(0, len(grams), BLOCK):
            block = grams[lo : lo + BLOCK]
            part = slice(*np.searchsorted(at, [lo, lo + BLOCK]))
            dense = np.zeros((b - a, len(block)), np.float32)
            dense[rows[part], at[part] - lo] = counts[part]
            out[a:b] += dense @ _gram_vectors(block, dimensions)
    return out


def fit(documents: DataFrame, per_language: int = SAMPLE, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from about `per_language` documents of each language outside the held-out fold.

    Every task adds up what it has; the driver gets a vector per language.  Documents count with unit
    length, so that a very long one does not stand for its language alone.
    """
    known = documents.select("doc_id", "text", "lang").filter(~held_out() & F.col("text").isNotNull())
    rows = bounded_sample(known, "doc_id", "lang", per_language).select("text", "lang")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for rows in batches:
            vectors = bundle(rows["text"].tolist(), dimensions).astype(np.float64)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for lang in rows["lang"].unique():
                sums[lang] = sums.get(lang, 0) + vectors[(rows["lang"] == lang).to_numpy()].sum(0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    sums: dict[str, np.ndarray] = {}
    for row in rows.mapInPandas(add, "lang string, v array<double>").toLocalIterator():
        sums[row.lang] = sums.get(row.lang, 0) + np.array(row.v)
    languages = sorted(k for k, v in sums.items() if np.any(v))
    if not languages:
        return Profiles()
    vectors = np.stack([sums[k] for k in languages])
    return Profiles(languages, (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32))


def classify(profiles: Profiles, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The nearest language and its cosine, cut to 0..1.  Ties go to the language first in the alphabet."""
    vectors = bundle(texts, profiles.vectors.shape[1])
    norms = np.linalg.norm(vectors, axis=1)
    if not profiles.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    cosines = vectors @ profiles.vectors.T / np.maximum(norms, 1e-9)[:, None]
    best = cosines.argmax(1)
    scores = np.where(norms > 0, cosines[np.arange(len(texts)), best], 0)
    has_letter = [isinstance(t, str) and any(map(str.isalpha, t)) for t in texts]
    return [profiles.languages[i] if ok else UNDETERMINED for i, ok in zip(best, has_letter)], np.round(np.clip(scores, 0, 1).astype(float), 6)


def predict(text: Column, profiles: Profiles) -> Column:
    """Struct of lang_pred and score for a whole text.  `und` and 0 for null, empty or letterless texts,
    and for all where nothing was learnt.  Equal texts get equal answers."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = classify(profiles, texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return run(text)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    found = predict(F.col("text"), fit(documents))
    return documents.select("doc_id", held_out().alias("held_out"), found.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


QUERIES = {"op5_language": op5_language}
SQL: dict[str, str] = {}
