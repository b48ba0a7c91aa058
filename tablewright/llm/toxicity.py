"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on the beginnings of words that set toxic
documents apart, so that all forms of an insult count, also those never met.  Each word of a document is a
window; it is compressed with the ordinary dictionary and with the toxic one (which follows on the ordinary
one, so that prose costs the same with either); the difference of the lengths is the window's evidence.  How many windows pass each of a few thresholds,
and how long the text is, give the probability; the weights are calibrated on labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import held_out, labelled_texts, slices, small_batches, table, utf8

#: Labelled documents per class that the dictionaries and weights are learnt from, about.
SAMPLE = 1000
#: Words of a window, and the words after which the next begins.
WORDS, HOP = 1, 1
#: Stands between words, so that a match of a whole word is longer than one of a syllable.
GAP = b"  "
#: Begins every window and lies in both dictionaries: each window then has a match, and a further one costs alike.
LEAD = b"#=window-of-words=#" + GAP
#: Ends every window: the compressor looks for no match that begins in the last eight bytes.
TAIL = GAP + b"#=#=#=#="
#: Ends the toxic dictionary, whose last bytes are not looked up.  It comes last, as the compressor tries the latest place first.
END = b"\n" * 8
ORDINARY_BYTES, TOXIC_BYTES = 8 << 10, 3 << 10
#: Bytes of the segments that the dictionary trainer picks.
SEGMENT = 40
#: Settings of the compressor: a look-up for every position, matches of six bytes or more.
LEVEL, HASH, MATCH, STRATEGY = 1, 16, 6, zstandard.STRATEGY_DFAST
#: Log of the reach of a match: both dictionaries whole.
WINDOW_LOG = 18
CUT = 0.5
#: Share of toxic documents that the probabilities are calibrated to.
PRIOR = 0.25
#: How clearly the beginning of a word must set toxic documents apart to be trained on, how much larger its share of
#: them must be than that of ordinary ones, and how many it must be in.
MARGIN, RATIO, SEEN = 6.0, 3.0, 3
#: Bytes of a beginning, the gap behind a short word included.
BEGIN_FROM, BEGIN_TO = 5, 12
#: Bytes of a word that are each followed by a sign of all before, so that a beginning matches only beginnings.
CHAINED = 12
#: Marks that a word may stand behind.
MARKS_BEFORE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Thresholds of a window, as the bytes that the toxic dictionary saves; what passing each is worth is learnt.
STEPS = (3, 5, 7, 9, 11)
#: Rounds in which mistaken ordinary windows join the ordinary dictionary, and their bytes a round.
ROUNDS, MISTAKEN_BYTES = 1, 4 << 10
#: Bytes of text whose windows are compressed at once, and windows whose result a worker remembers.
STEP_BYTES, REMEMBERED = 1 << 20, 200_000


@dataclass(frozen=True)
class Distances:
    """Both dictionaries and the logistic weights: an offset, one for each threshold, one for the length."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Raw content, so that literals cost whole bytes and prose the same under both dictionaries."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(dictionary), window_log=WINDOW_LOG, min_match=MATCH, strategy=STRATEGY, hash_log=HASH, chain_log=HASH, search_log=4,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


def _windows(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-cased windows, and for each occurrence the window's and the text's number.  A text without
    words has no window."""
    numbers: dict[bytes, int] = {}
    which: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        own = [GAP.join(words[at : at + WORDS]) for at in range(0, max(len(words) - WORDS, 0) + 1, HOP)] if words else []
        which += [numbers.setdefault(w, len(numbers)) for w in own]
        counts[i] = len(own)
    return list(numbers), np.array(which, np.int64), np.repeat(np.arange(len(texts)), counts)


def _bare(word: bytes) -> bytes:
    return word.lstrip(MARKS_BEFORE) or word


@lru_cache(100_000)
def _code(word: bytes) -> bytes:
    """A word as it is compressed: without marks before it, its first bytes chained."""
    word = _bare(word)
    out, sign = bytearray(), 7
    for byte in word[:CHAINED]:
        sign = (sign * 31 + byte + 1) & 255
        out += bytes((byte, sign))
    return bytes(out) + word[CHAINED:]


def _coded(window: bytes) -> bytes:
    return GAP.join(map(_code, window.split(GAP)))


def _lengths(dictionary: bytes, windows: list[bytes]) -> np.ndarray:
    """Compressed length of every window."""
    packed = _compressor(dictionary).multi_compress_to_buffer(windows)
    return np.fromiter(map(len, packed), np.int32, len(packed))


def savings(model: Distances, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each window that the toxic dictionary saves over the ordinary one, and the windows' texts.  A worker remembers windows: most words come again and again."""
    windows, which, owner = _windows(texts)
    known = _remembered(model)
    new = [w for w in windows if w not in known]
    if new:
        framed = [LEAD + _coded(w) + TAIL for w in new]
        fresh = dict(zip(new, (_lengths(model.ordinary, framed) - _lengths(model.toxic, framed)).tolist()))
    else:
        fresh = {}
    values = np.fromiter((fresh[w] if w in fresh else known[w] for w in windows), float, len(windows))
    known.update(fresh)
    return values[which], owner


@lru_cache(2)
def _memory(model: Distances) -> dict[bytes, float]:
    return {}


def _remembered(model: Distances) -> dict[bytes, float]:
    known = _memory(model)
    if len(known) > REMEMBERED:
        known.clear()
    return known


def _features(model: Distances, texts: list[bytes]) -> np.ndarray:
    """Per text: log(1 + windows that save a threshold or more) for each threshold, and log(1 + windows)."""
    out = np.zeros((len(texts), len(STEPS) + 1))
    for a, b in slices(np.array([len(t) for t in texts]), STEP_BYTES):
        saved, owner = savings(model, texts[a:b])
        for k, step in enumerate(STEPS):
            out[a:b, k] = np.log1p(np.bincount(owner, saved >= step, b - a))
        out[a:b, -1] = np.log1p(np.bincount(owner, minlength=b - a))
    return out


def scores(model: Distances, texts: list[bytes]) -> np.ndarray:
    features = _features(model, texts)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + features @ np.array(model.weights[1:]), -30, 30)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" nothing "


def _begins(word: bytes) -> list[bytes]:
    word = _bare(word) + GAP
    return [word[:k] for k in range(BEGIN_FROM, min(len(word), BEGIN_TO) + 1)]


def _marks(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """Beginnings of words in clearly more toxic than ordinary documents: the log-likelihood ratio of their document counts."""
    n, m = len(toxic), len(ordinary)
    a, b = Counter(), Counter()
    for t in toxic:
        a.update({p for w in set(t.lower().split()) for p in _begins(w)})
    for t in ordinary:
        b.update({p for w in set(t.lower().split()) for p in _begins(w) if p in a})
    marks = {}
    for p, k in a.items():
        j, share = b[p], (k + b[p]) / (n + m)
        if k < SEEN or k / n <= RATIO * j / max(m, 1):
            continue
        ratio = k * np.log(k / (n * share)) + (j * np.log(j / (m * share)) if j else 0)
        if ratio > 0.5 * np.log(n + m) + MARGIN:
            marks[p] = float(ratio)
    return marks


def _mark(word: bytes, marks: dict[bytes, float]) -> bytes:
    """The beginning of a word that sets toxic documents apart most clearly, the longest of equals; empty if none does."""
    return max((p for p in _begins(word) if p in marks), key=lambda p: (marks[p], len(p)), default=b"")


def _passages(texts: list[bytes], marks: dict[bytes, float]) -> list[bytes]:
    """The marked beginnings of each text, in the order of its words: what sets it apart from ordinary text."""
    found = ([p for p in (_mark(w, marks) for w in t.lower().split()) if p] for t in texts)
    return [GAP + GAP.join(_code(p.rstrip()) + (GAP if p.endswith(b" ") else b"") for p in own) + GAP for own in found if own]


def train(toxic: list[bytes], ordinary: list[bytes]) -> Distances:
    """Dictionaries from the passages that set toxic documents apart and from ordinary text; then what
    passing each threshold is worth, from both classes' documents."""
    if not toxic or not ordinary:
        return Distances(b" nothing ", b" nothing ", (4.0 if toxic else -4.0, *[0.0] * (len(STEPS) + 1)))
    marks = _marks(toxic, ordinary)
    plain = [GAP + _code(w) + GAP for t in ordinary for w in t.lower().split()[::4] if not _mark(w, marks)]
    lengths = (0.0,) * (len(STEPS) + 2)
    base = LEAD + _dictionary(plain, ORDINARY_BYTES)
    evil = _dictionary(_passages(toxic, marks), TOXIC_BYTES) + END
    for _ in range(ROUNDS):  # what ordinary text shares with the toxic dictionary belongs into the ordinary one
        base += _mistaken(Distances(base + evil, base, lengths), ordinary, marks)
    model = Distances(base + evil, base, lengths)
    features = np.vstack([_features(model, toxic), _features(model, ordinary)])
    labels = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    return replace(model, weights=_logistic(features, labels))


def _mistaken(model: Distances, ordinary: list[bytes], marks: dict[bytes, float]) -> bytes:
    """The windows of ordinary text without a marked beginning that look toxic most often, as further content of the ordinary dictionary."""
    found: Counter = Counter()
    for a, b in slices(np.array([len(t) for t in ordinary]), STEP_BYTES):
        windows, which, _ = _windows(ordinary[a:b])
        saved, _ = savings(model, ordinary[a:b])
        for w, k in zip(*np.unique(which[saved > 0], return_counts=True)):
            found[windows[w]] += int(k)
    worst = sorted(found, key=lambda w: (-found[w], w))
    return (GAP + GAP.join(_coded(w) for w in worst if not any(_mark(v, marks) for v in w.split(GAP))) + GAP)[:MISTAKEN_BYTES]


def _logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-3) -> tuple[float, ...]:
    """Newton's method; toxic documents weigh PRIOR together."""
    x = np.hstack([np.ones((len(features), 1)), features])
    share = np.where(labels == 1, PRIOR / labels.sum(), (1 - PRIOR) / (1 - labels).sum())
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - labels)) + penalty * w
        w = w - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
    return tuple(float(v) for v in w)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Distances:
    """Both dictionaries and the calibration from about `per_class` documents of each label outside the held-out fold."""
    rows = labelled_texts(documents, labels, "toxic", per_class).toPandas().sort_values("doc_id")
    return train(utf8(rows["text"][rows["label"] == 1]), utf8(rows["text"][rows["label"] == 0]))


def toxicity_score(text: Column, model: Distances) -> Column:
    """Probability that a whole text is toxic.  Null counts as the empty text, which has no window and so no
    evidence.  Equal texts score alike, letters' case does not matter."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(model, utf8(texts)))

    return run(text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", held_out().alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
