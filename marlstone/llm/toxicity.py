"""Toxicity by compression distance: windows that a toxic dictionary shortens more than an ordinary one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import quoted

# Labelled texts the model is trained on, at most, and the longest text among them.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 3000, 6000, 16_000
WINDOW, STRIDE = 80, 64
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 32_768, 24_576, 6_000
LEVELS = (1, 2, 3, 4)


def windows(text: bytes) -> list[bytes]:
    """Overlapping pieces of a whole text with A-Z in lower case; a word of up to 16 bytes lies in one of them entirely."""
    text = text.lower()
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Lazy matching of four bytes and more against the whole dictionary, so that only its content makes lengths differ."""
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_dict_id=0)
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters)


class Distance:
    """Bytes that each window of a text is shorter with the toxic dictionary than with the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic + ordinary), _compressor(ordinary)

    def gains(self, text: bytes) -> np.ndarray:
        short, plain = self.toxic.compress, self.ordinary.compress
        return np.array([len(plain(w)) - len(short(w)) for w in windows(text)])

    def features(self, text: bytes) -> list[float]:
        gain = self.gains(text)
        return [min(gain.max(), 12) / 4, gain.clip(0).mean(), math.log1p(gain.clip(0).sum()) / 2,
                *[math.log1p((gain >= k).sum() ** 2 / len(gain)) for k in LEVELS], math.log(len(gain)) / 4]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic part and the ordinary dictionary, which the toxic one contains too.

    Both are trained on windows of their texts.  Then windows of ordinary texts that the toxic part
    shortens anyway are added to the ordinary dictionary.
    """
    part = _dictionary(TOXIC_BYTES, [w for t in toxic for w in windows(t)])
    plain = [w for t in ordinary for w in windows(t)]
    order = np.random.default_rng(0).permutation(len(plain))
    base = _dictionary(ORDINARY_BYTES, [plain[i] for i in order[:40_000]])
    distance = Distance(part, base)
    hard = [plain[i] for i in order if len(distance.ordinary.compress(plain[i])) - len(distance.toxic.compress(plain[i])) >= 2]
    if hard:
        base = _dictionary(min(HARD_BYTES, max(2048, 30 * len(hard))), hard) + base
    return part, base


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Intercept and weights by Newton steps."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Dictionaries and calibrated thresholds; without texts of both labels, a constant."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], toxic_share: float):
        self.parts, self.weights = None, np.zeros(0)
        self.constant = min(max(toxic_share, 1e-3), 1 - 1e-3) if toxic or ordinary else 0.0
        if len(toxic) < 5 or len(ordinary) < 5:
            return
        # Two thirds train the dictionaries, one third, which they have not seen, sets the thresholds.
        self.parts = train_dictionaries([t for i, t in enumerate(toxic) if i % 3], [t for i, t in enumerate(ordinary) if i % 3])
        distance = Distance(*self.parts)
        held = toxic[::3], ordinary[::3]
        x = np.array([distance.features(t) for texts in held for t in texts])
        y = np.repeat([1.0, 0.0], [len(t) for t in held])
        weight = np.repeat([toxic_share * len(x) / len(held[0]), (1 - toxic_share) * len(x) / len(held[1])], [len(t) for t in held])
        self.weights = fit_logistic(x, y, weight)

    def scorer(self):
        if self.parts is None:
            return lambda text: self.constant
        distance, w = Distance(*self.parts), self.weights
        return lambda text: float(1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + float(np.dot(w[1:], distance.features(text))))))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        usable: Column | None = None, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, max_bytes: int = MAX_BYTES) -> Model:
    """A model from labelled texts of up to ``max_bytes`` bytes, ``max_toxic`` and ``max_ordinary`` of them at most, chosen by hash of the id.

    ``usable`` tells which rows of ``labels`` may be learnt from.
    """
    known = labels.where(usable) if usable is not None else labels
    known = known.select(quoted(id_col).alias("doc"), quoted(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).distinct()
    share = known.agg(F.avg("y")).first()[0] or 0.0
    text = quoted(text_col).cast("binary")
    sizes = docs.select(quoted(id_col).alias("doc"), F.octet_length(text).alias("n")).where((F.col("n") > 0) & (F.col("n") <= max_bytes))
    rows = sizes.join(known, "doc")
    # Ids first: the texts of a bounded number of them need no shuffle.
    chosen = [rows.where(F.col("y") == y).select("doc", "y").distinct().orderBy(F.xxhash64("doc"), "doc").limit(most) for y, most in ((1, max_toxic), (0, max_ordinary))]
    ids = docs.sparkSession.createDataFrame(chosen[0].collect() + chosen[1].collect(), chosen[0].schema)
    texts = (docs.select(quoted(id_col).alias("doc"), text.alias("text")).join(F.broadcast(ids), "doc")
             .where((F.octet_length("text") > 0) & (F.octet_length("text") <= max_bytes)).orderBy(F.xxhash64("doc"), "doc").limit(2 * (max_toxic + max_ordinary)).collect())
    taken = [[bytes(r["text"]) for r in texts if r["y"] == y] for y in (1, 0)]
    return Model(*taken, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score): the probability that a text is toxic, from all windows of the whole text.

    One pass, no shuffle; the model is about 64 KB.  Null and empty texts are one empty window and have a
    score too; rows that share an id are scored one by one; an empty table has no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores = [scorer(t or b"") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc", "score"])

    rows = docs.select(quoted(id_col).alias("doc"), quoted(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")
