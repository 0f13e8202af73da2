"""Toxicity by compression distance: two zstandard dictionaries, window by window.

One dictionary is trained on toxic text and one on ordinary text.  A text is cut
into windows of about ``WINDOW`` bytes at blanks, every window is compressed
with either dictionary, and the bytes that the toxic dictionary saves are held
against thresholds.  A logistic regression on those counts, calibrated on
labelled texts that the dictionaries have not seen, gives the score.

What goes into a dictionary: both hold the same base, which zstandard's trainer
makes from ordinary text, so that only what a class adds can move a window's
length.  The toxic one adds what the trainer makes from toxic text: of the runs in
it that typical toxic strings cover, for whole toxic texts are mostly ordinary
(nothing where the runs are under 25,600 bytes: too few to train on).
Both add, beside the trainer's work, the strings of the class's texts that cover
its typical strings.  A string (6 to 12 bytes, the blank before a word included) is typical
by how often it occurs inside the class's texts, against how often it does so in
the other's; pieces of ordinary text that hold a typical toxic string are kept
out of the base, where they would hide it.

The fit uses a bounded sample of labelled texts (``SAMPLE``), read by the driver.
Scoring is one pass over the documents, without a shuffle.

Defined cases: null and empty texts are one empty window and get the score of
that; repeated rows score alike; without texts of both classes the score is the
share of label 1 (0 without labels).
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, flat, tidy
from .labelled import held_out, logistic, training_ids

#: Labelled texts of each class, and bytes of them, at most; the share of them that makes the dictionaries.
SAMPLE = {1: 1500, 0: 9000}
DICTIONARY_SHARE = 0.6
#: Texts, and share of a class's texts, that a string must be in to be typical (a copied passage is in fewer);
#: how often one text's occurrences count at most.
LEAST_TEXTS = 8
LEAST_SHARE = {1: 0.03, 0: 0.005}
MOST_OF_A_TEXT = 8
SAMPLE_BYTES = 48 << 20
WINDOW = 80
#: Bytes of the strings held against the other class, and how much denser they must be there; by label.
LENGTHS = {1: (6, 8, 10, 12), 0: (6,)}
RATIO = {1: 8, 0: 20}
GRAM = 6
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BASE_BYTES = 32 << 10
#: Pieces of the sample's ordinary texts that the base is trained on, drawn with a seed.
BASE_PIECES = 20_000
OWN_BYTES = 16 << 10
#: What the trainer makes of toxic runs: bytes at most, bytes of runs to one byte of it (the trainer's manual
#: advises about 100), and at least (the trainer's own minimum: from fewer runs it learns noise);
#: its segments' and strings' bytes, runs in one sample, and room for the header cut off.
TRAINED_BYTES, RUN_BYTES_TO_ONE, LEAST_TRAINED = 4 << 10, 100, 256
SEGMENT, SEGMENT_STRING, RUNS_IN_SAMPLE, HEADER_BYTES = 16, 6, 8, 300
THRESHOLDS = (2, 4, 6, 8)


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of about ``size`` bytes, cut at a blank if one is near."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n and 0 <= (blank := text.find(b" ", end, end + 24)):
            end = blank
        out.append(text[at:end])
        at = end
    return out or [b""]


def grams(text: bytes, n: int = GRAM) -> np.ndarray:
    """64-bit hashes of the strings of ``n`` bytes."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(a) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(a) - n + 1, np.uint64)
    for k in range(n):
        out = out * FACTOR + a[k:len(a) - n + 1 + k] + np.uint64(1)
    return out


def _places(text: bytes, n: int, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the text holds one of the sorted ``strings``, and which."""
    found = grams(text, n)
    if not len(strings) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.minimum(np.searchsorted(strings, found), len(strings) - 1)
    hit = np.flatnonzero(strings[which] == found)
    return hit, which[hit]


def _frequent(texts: list[bytes], n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Strings that at least ``least`` texts hold, sorted, with their occurrences."""
    values, occurrences = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for t in texts:
        v, c = np.unique(grams(t, n), return_counts=True)
        values.append(v)
        occurrences.append(np.minimum(c, MOST_OF_A_TEXT).astype(np.uint8))
    values, occurrences = np.concatenate(values), np.concatenate(occurrences)
    order = np.argsort(values)
    values, occurrences = values[order], occurrences[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][:len(values)])
    often = np.diff(np.r_[first, len(values)]) >= least
    sums = np.add.reduceat(occurrences, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return values[first][often], sums[often]


def _typical(own: list[bytes], other: list[bytes], n: int, least: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``n`` bytes in at least ``least`` of a class's texts, ``ratio`` times as dense there as in the other's, and their occurrences."""
    values, occurrences = _frequent(own, n, least)
    there = np.zeros(len(values), np.int64)
    for t in other:
        which, c = np.unique(_places(t, n, values)[1], return_counts=True)
        there[which] += np.minimum(c, MOST_OF_A_TEXT)
    size, other_size = (sum(map(len, x)) + 1 for x in (own, other))
    dense = occurrences / size > ratio * (there + 0.5) / other_size
    return values[dense], occurrences[dense]


def _own_strings(texts: list[bytes], typical: dict[int, tuple[np.ndarray, np.ndarray]], limit: int) -> bytes:
    """Typical strings that cover the texts without overlap, most bytes first; those of most texts last (nearest).

    A string that only adds its neighbours to a more frequent one overlaps it
    wherever it occurs and is left out.
    """
    used: Counter[bytes] = Counter()
    for t in texts:
        parts = []
        for n, (strings, occurrences) in typical.items():
            hit, which = _places(t, n, strings)
            parts.append(np.c_[occurrences[which] * -n, hit, np.full(len(hit), n)])
        free, own = bytearray(b"\1" * len(t)), set()
        for _, at, n in sorted(map(tuple, np.concatenate(parts).tolist())):
            if free.find(0, at, at + n) < 0:
                free[at:at + n] = bytes(n)
                own.add(t[at:at + n])
        used.update(own)
    out, size = [], 0
    for string, n in sorted(used.items(), key=lambda x: (-x[1] * len(x[0]), x[0])):
        if n >= LEAST_TEXTS and size + len(string) <= limit:
            out.append(string)
            size += len(string)
    return b"".join(reversed(out))


def _covered(text: bytes, typical: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """The longest runs of the text that typical strings cover."""
    steps = np.zeros(len(text) + 1, np.int64)
    for n, (strings, _) in typical.items():
        at, _ = _places(text, n, strings)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n, -1)
    edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(steps) > 0, 0])).tolist()
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _trained(runs: list[bytes]) -> bytes:
    """What zstandard's trainer makes from the runs, without its header; nothing from too few of them."""
    size = min(TRAINED_BYTES, sum(map(len, runs)) // RUN_BYTES_TO_ONE)
    samples = [b"".join(runs[i:i + RUNS_IN_SAMPLE]) for i in range(0, len(runs), RUNS_IN_SAMPLE)]
    if size < LEAST_TRAINED:
        return b""
    try:
        return zs.train_dictionary(size + HEADER_BYTES, samples, k=SEGMENT, d=SEGMENT_STRING).as_bytes()[-size:]
    except zs.ZstdError:  # too little text to train on
        return b""


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def compressors(self):
        def make(content: bytes) -> zs.ZstdCompressor:
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            p = zs.ZstdCompressionParameters(
                window_log=17, chain_log=15, hash_log=16, search_log=4, min_match=5, target_length=8,
                strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
                format=zs.FORMAT_ZSTD1_MAGICLESS)
            d.precompute_compress(compression_params=p)
            return zs.ZstdCompressor(dict_data=d, compression_params=p)
        return make(self.toxic), make(self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        z = self.weights[0] + ((features - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def window_features(texts: list[bytes], toxic: zs.ZstdCompressor, ordinary: zs.ZstdCompressor) -> np.ndarray:
    """Per lower-cased text: what the toxic dictionary saves in its windows."""
    out = np.zeros((len(texts), 6 + 2 * len(THRESHOLDS)))
    for i, t in enumerate(texts):
        saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(t)], float)
        top = np.sort(saved)[::-1]
        over = [(saved >= x).sum() for x in THRESHOLDS]
        out[i] = [top[0], top[:2].sum(), top[:4].sum(), top[-1], saved.mean(), np.log1p(len(saved)),
                  *(x / len(saved) for x in over), *np.log1p(over)]
    return out


def _dictionaries(own: dict[int, list[bytes]], seed: int) -> ToxicityModel:
    """Both classes' dictionaries, not calibrated yet."""
    least = {v: max(LEAST_TEXTS, LEAST_SHARE[v] * len(x)) for v, x in own.items()}
    typical = {v: {n: _typical(own[v], own[1 - v], n, least[v], RATIO[v]) for n in LENGTHS[v]} for v in own}
    strings = {v: _own_strings(own[v], typical[v], OWN_BYTES) for v in own}
    pieces = [w for t in own[0] for w in windows(t, 256)]
    random.Random(seed).shuffle(pieces)
    pieces = [w for w in pieces[:BASE_PIECES] if not any(len(_places(w, n, x)[0]) for n, (x, _) in typical[1].items())]
    try:
        base = zs.train_dictionary(BASE_BYTES, pieces).as_bytes()[1024:]
    except zs.ZstdError:  # too little text to train on
        base = b"".join(pieces)[:BASE_BYTES]
    trained = _trained([r for t in own[1] for r in _covered(t, typical[1])])
    return ToxicityModel(strings[1] + trained + base, strings[0] + base, np.zeros(0), np.zeros(0), np.ones(0))


def fit_toxicity(texts: list[bytes], labels: list[int], seed: int = 5) -> ToxicityModel:
    """Dictionaries from most of each class's texts, the weights of the thresholds from the others."""
    by_class = {v: [t for t, y in zip(texts, labels, strict=True) if y == v] for v in (0, 1)}
    cut = {v: int(len(x) * DICTIONARY_SHARE) for v, x in by_class.items()}
    if min(cut.values()) < 1:
        return ToxicityModel(b"", b"", np.zeros(0), np.zeros(0), np.ones(0), float(np.mean(labels)) if labels else 0.0)
    model = _dictionaries({v: x[:cut[v]] for v, x in by_class.items()}, seed)
    rest = {v: x[cut[v]:] for v, x in by_class.items()}
    x = window_features(rest[0] + rest[1], *model.compressors())
    model.weights, model.mean, model.scale = logistic(x, np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])]))
    return model


def sample_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[bytes], list[int]]:
    """Whole lower-cased texts of a bounded sample of labelled documents, in hash order."""
    ids = training_ids(labels, label, SAMPLE)
    rows = (docs.join(F.broadcast(ids), "doc_id").select("draw", "label", "text")  # at most sum(SAMPLE) ids
            .orderBy("draw"))
    texts, ys, size = [], [], 0
    for r in rows.toLocalIterator():
        t = bytes(LOWER[np.frombuffer((r["text"] or "").encode(), np.uint8)])
        size += len(t)
        if texts and size > SAMPLE_BYTES:
            break
        texts.append(t)
        ys.append(int(r["label"]))
    return texts, ys


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every whole text; ``docs`` may have any other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # two dictionaries of bounded size and a few weights

    def run(batches):
        m = ToxicityModel(**shared.value)
        both = m.compressors()
        for b in batches:
            data, offsets = flat(b.column(1))
            scores = np.empty(len(b))
            for lo in range(0, len(b), 256):
                hi = min(len(b), lo + 256)
                texts = [bytes(LOWER[data[s:e]]) for s, e in zip(offsets[lo:hi], offsets[lo + 1:hi + 1], strict=True)]
                if m.constant is not None:
                    scores[lo:hi] = m.constant
                else:
                    scores[lo:hi] = m.score(window_features(texts, *both))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(run), f"key {kind}, score double").withColumnRenamed("key", key)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every document; labels are learned outside the held-out fold only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(*sample_texts(docs.select("doc_id", "text"), labels))
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
