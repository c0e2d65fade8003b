"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A text is cut into overlapping windows; each window is compressed with both,
and how much shorter the toxic dictionary makes it is the window's advantage.
A logistic model over the largest advantages and the shares of windows above
fixed thresholds, fitted on labelled rows that trained no dictionary, turns
them into a calibrated score.

For compression a byte becomes four: the hash of itself and up to three bytes
before it in its word. A stretch shared with a dictionary then saves a multiple
of its length, while chance matches of single letters save nothing. Every
window ends in a run of zeros, so that zstandard never stores it raw.

Both dictionaries come from ``zstandard.train_dictionary``. The ordinary one is
trained on words of ordinary texts. The toxic one has two trained parts: the
same ordinary part, as toxic texts consist of ordinary words too and what both
dictionaries know must cancel, and a part trained on all occurrences of words
that are over-represented in toxic texts (a stem of theirs lies in at least
SHARE of these texts, with log odds above ODDS). How much of it enters is for
the trainer to decide; no list is cut.

Training takes at most TRAIN_ROWS labelled rows of each class, those with the
least hash of their id, with texts of at most TRAIN_CHARS characters. Scores
cover whole texts of all rows and use nothing but the text.

Defined cases: null text counts as empty and gets a score like any other;
labels that are null, neither 0 nor 1, or of unknown documents train nothing;
rows with a null id are scored and never held out; without both classes among
the training rows every score is the share of label 1 among them (0 if none).
Texts are scored whole, a few megabytes at a time, a longer one by itself; texts
longer than TRAIN_CHARS train nothing; other columns stay in ``doc``, whatever
their names.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
SPAN, STEP, PAD = 64, 48, 16
#: Bytes of a trained part (codes, four a letter), and the most words it is trained on.
DICTIONARY_BYTES, SAMPLES = 32_768, 400_000
SHARE, ODDS = 0.03, 3.5
THRESHOLD = 0.3
_TOP, _COUNTS, _SHARES = (0, 1, 2, 4), (6, 9, 12, 16, 20), (9, 12, 16)
_U = np.uint64
_LETTER = np.ones(256, bool)
_LETTER[:48] = _LETTER[58:65] = _LETTER[91:97] = _LETTER[123:128] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def units(data: np.ndarray) -> np.ndarray:
    """Four-byte codes of bytes in the context of their word."""
    live = _LETTER[data]
    letters = np.where(live, _LOWER[data], _U(0))
    inside, code = live, letters.copy()
    for i in (1, 2, 3):
        before, there = np.zeros_like(letters), np.zeros_like(inside)
        before[i:], there[i:] = letters[:-i], inside[:-i]
        live = live & there
        code += np.where(live, before, _U(0)) * _U(257**i)
    code = (code + _U(1)) * _U(0x9E3779B97F4A7C15)
    code ^= code >> _U(32)
    return ((code * _U(0xBF58476D1CE4E5B9)) >> _U(32)).astype(np.uint32)


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0


def _compressor(content: bytes) -> zs.ZstdCompressor:
    options = zs.ZstdCompressionParameters.from_level(3, source_size=(SPAN + PAD) * 4, dict_size=len(content), write_content_size=False, write_dict_id=False)
    # as content: entropy tables would make letters themselves cheaper on one side
    dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=options)
    return zs.ZstdCompressor(compression_params=options, dict_data=dictionary)


def _sizes(compressor: zs.ZstdCompressor, windows: np.ndarray) -> np.ndarray:
    width = windows.shape[1] * 4
    segments = np.empty((len(windows), 2), np.uint64)
    segments[:, 0], segments[:, 1] = np.arange(len(windows), dtype=np.uint64) * _U(width), width
    out = compressor.multi_compress_to_buffer(zs.BufferWithSegments(windows.tobytes(), segments.tobytes()))
    return np.fromiter((len(out[i]) for i in range(len(windows))), np.int64, len(windows))


def _features(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pair: tuple[zs.ZstdCompressor, zs.ZstdCompressor]) -> np.ndarray:
    """One row of features for each text; texts stand one after the other in ``data``."""
    codes = np.concatenate([units(data[max(0, at - 3) : at + (4 << 20)])[min(3, at) :] for at in range(0, len(data), 4 << 20)] or [np.zeros(0, np.uint32)])
    # context does not cross texts: a text's first bytes are coded anew
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        codes[s : s + min(3, n)] = units(data[s : s + min(3, n)])
    per = np.maximum(1, -(-(sizes - (SPAN - STEP)) // STEP))
    owner = np.repeat(np.arange(len(sizes)), per)
    first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    last = (starts + sizes)[owner]
    advantage = np.empty(len(owner))
    for at in range(0, len(owner), 8192):
        spots = first[at : at + 8192, None] + np.arange(SPAN)
        windows = np.zeros((len(spots), SPAN + PAD), np.uint32)
        inside = spots < last[at : at + 8192, None]
        windows[:, :SPAN][inside] = codes[spots[inside]]
        advantage[at : at + 8192] = _sizes(pair[1], windows) - _sizes(pair[0], windows)
    order = np.lexsort((-advantage, owner))
    begin = np.cumsum(per) - per
    out = [np.where(per > k, advantage[order][np.minimum(begin + k, len(order) - 1)], 0.0) for k in _TOP]
    out.append(np.log1p(per))
    above = {k: np.bincount(owner, advantage >= k, len(per)) for k in {*_COUNTS, *_SHARES}}
    out += [np.log1p(above[k]) for k in _COUNTS] + [above[k] / per for k in _SHARES]
    return np.stack(out, axis=1)


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, sizes) of a few megabytes of whole texts each."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    k = 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - sizes[k] + (2 << 20), "right")))
        data = np.frombuffer(b"".join(column.slice(k, to - k).to_pylist()), np.uint8)
        yield k, data, np.cumsum(sizes[k:to]) - sizes[k:to], sizes[k:to]
        k = to


def _scores(features: np.ndarray, model: Model) -> np.ndarray:
    z = np.column_stack([np.ones(len(features)), (features - model.mean) / model.scale])
    return 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))


def scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    if not len(model.weights):
        return lambda column: np.full(len(column), model.prior)
    pair = _compressor(model.toxic), _compressor(model.ordinary)

    def score(column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for first, data, starts, sizes in _slices(column):
            out[first : first + len(sizes)] = _scores(_features(data, starts, sizes, pair), model)
        return out

    return score


def _words(text: str) -> list[bytes]:
    return [w.strip(b".,;:!?\"'") for w in text.lower().encode().split()]


def _stems(text: str) -> set[bytes]:
    out = set()
    for word in set(_words(text)):
        out.update(word[:n] for n in range(4, min(len(word), 12) + 1))
        out.add(word + b" ")
    return out


def _favoured(mine: list[str], others: list[str]) -> set[bytes]:
    """Stems over-represented in the texts of a class."""
    inside, outside = Counter(s for t in mine for s in _stems(t)), Counter(s for t in others for s in _stems(t))
    lead = lambda s, n: math.log((n + 0.5) / (len(mine) + 1)) - math.log((outside[s] + 0.5) / (len(others) + 1))
    return {s for s, n in inside.items() if n >= max(3, math.ceil(SHARE * len(mine))) and lead(s, n) > ODDS}


def _trained(words: list[bytes]) -> bytes:
    """A dictionary of the codes of words; of all of them, the rest repeated, if they are too few to train on."""
    order = random.Random(1)
    words = order.sample(words, min(len(words), SAMPLES))
    samples = [units(np.frombuffer(b" " + w + b" ", np.uint8)).tobytes() for w in words]
    try:
        return zs.train_dictionary(DICTIONARY_BYTES, samples, k=48, d=8, steps=4).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or bytes(8)


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary); zstandard favours a dictionary's end, so the toxic part comes last."""
    stems = _favoured(toxic, ordinary)
    every = [w for t in toxic for w in _words(t)]
    own = [w for w in every if w + b" " in stems or any(w[:n] in stems for n in range(4, min(len(w), 12) + 1))]
    common = _trained([w for t in ordinary for w in _words(t)])
    return common + _trained(own or every), common


def train(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """The first half of each class trains dictionaries, the second the calibration."""
    if not toxic or not ordinary:
        return Model(prior=prior)
    half = lambda x: (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :] or x)
    (first, second), (other, rest) = half(toxic), half(ordinary)
    model = Model(*dictionaries(first, other), prior=prior)
    pair = _compressor(model.toxic), _compressor(model.ordinary)
    x = np.concatenate([_features(*part[1:], pair) for part in _slices(pa.array(second + rest, pa.string()))])
    y = np.array([1.0] * len(second) + [0.0] * len(rest))
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    ridge = np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = b
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    least = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    picked = F.broadcast(least[0].unionByName(least[1]))  # at most 2 * rows ids
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") <= TRAIN_CHARS).join(picked, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    texts = sorted(((zlib.crc32(str(r["id"]).encode()), r["y"], r["text"]) for r in found.toArrow().to_pylist()))
    return train([t for _, y, t in texts if y == 1], [t for _, y, t in texts if y == 0], prior)


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default, in the struct ``doc``) with held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("held_out"), pa.array(score(batch.column("text")))], names=["doc", "held_out", "score"])

    rows = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    schema = rows.select("doc", "held_out", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
