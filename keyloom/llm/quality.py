"""Quality classifier: the difference between two compressed sizes, calibrated.

Two zstandard dictionaries are trained, one from good and one from bad labelled
texts.  A text is compressed in blocks of ``block`` bytes with either; blocks keep
a long text from becoming its own dictionary.  The difference of the summed sizes,
divided by the larger, and the compressed share of the text are the only features
of a logistic curve, fitted on labelled rows that built no dictionary (or on the only row of its class).

Nulls and empty texts have difference and share zero, and so the score that the
curve has there.  Repeated rows score alike.  With no usable labelled row of one class
the score is the other class's share (0.5 with no labels at all).  Columns of the
input other than text and key are passed on; ``score`` and ``predicted`` replace
columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, lowest, stored, texts


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    share: float
    block: int
    level: int


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.sides = []
        if model.good and model.bad:
            for raw in (model.good, model.bad):
                side = zstandard.ZstdCompressionDict(raw)
                side.precompute_compress(level=model.level)
                self.sides.append(zstandard.ZstdCompressor(dict_data=side, level=model.level, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        n = self.model.block
        blocks = [text[i : i + n] for i in range(0, len(text), n)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.sides)
        return (bad - good) / max(good, bad), good / len(text)

    def score(self, given: list[bytes]) -> list[float]:
        if not self.sides:
            return [self.model.share] * len(given)
        x = _terms(np.array([self.features(t) for t in given], dtype=float).reshape(-1, 2))
        return (1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -30, 30)))).tolist()


def _terms(x: np.ndarray) -> np.ndarray:
    d, r = x[:, 0], np.minimum(x[:, 1], 1.5)
    return np.stack([np.ones(len(d)), d, r, d * r, d * d, r * r], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn_from,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 2000,
    max_text_bytes: int = 65536,
    dict_bytes: int = 112640,
    block: int = 1024,
    level: int = 3,
) -> Model:
    """Learns from at most ``sample_rows`` different texts of each label, those that hash lowest.

    Labels are first brought together with the documents that have a usable text, so
    labels without one do not shrink the sample, and copies of a text count once, so
    that none is in the dictionary and among the rows of the curve.  That bound, and
    ``max_text_bytes`` for one training text, hold the sample that reaches the driver to
    a fixed size at any corpus size; longer texts are scored whole but train nothing.
    ``learn_from`` is the condition (over the key) that a row may be learned from.
    Class shares come from all labels that fulfil it.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label).where(learn_from).distinct()
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    given = docs.where(F.col(key).isNotNull() & (F.length(F.col(text)) > 0) & (F.octet_length(F.col(text)) <= max_text_bytes))
    given = given.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    labelled = given.select("key", "th").join(usable.select(F.col(key).alias("key"), F.col(label).alias("label")), "key")
    ids = stored(lowest(labelled, "label", "th", sample_rows).groupBy("label", "th").agg(F.min("key").alias("key")), "quality-sample")
    rows = given.join(ids, ["key", "th"]).groupBy("label", "th").agg(F.first("text").alias("text")).select("th", "label", "text").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    sides = {s: [r[2].encode("utf-8", "surrogatepass") for r in rows if r[1] == s] for s in (0, 1)}
    if not all(sides.values()):
        return Model(b"", b"", (), share, block, level)
    raw = {s: _dictionary([t for i, t in enumerate(x) if i % 2 == 0], dict_bytes, block) for s, x in sides.items()}
    model = Model(raw[1], raw[0], (), share, block, level)
    scorer = Scorer(model)
    x, y, w = [], [], []
    for s, given in sides.items():
        rest = given[1::2] or given
        x += [scorer.features(t) for t in rest]
        y += [s] * len(rest)
        w += [(share if s else 1 - share) / len(rest)] * len(rest)
    w = np.array(w) * len(w)
    beta = _logistic(_terms(np.array(x)), np.array(y, dtype=float), w)
    return Model(raw[1], raw[0], tuple(float(b) for b in beta), share, block, level)


def _dictionary(given: list[bytes], size: int, block: int) -> bytes:
    samples = [t[i : i + block] for t in given for i in range(0, len(t), block)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 4)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the texts themselves are the dictionary
        return b"".join(samples)[-size:]


def with_scores(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) to every row.

    ``keep`` names the columns that pass through (all by default).
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, at most dict_bytes each
    fields = [f for f in docs.schema.fields if f.name in kept]
    given = docs.select(*kept) if text in kept else docs.select(*kept, text)
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        scorer = Scorer(shared.value)

        def each(batch):
            score = scorer.score(texts(batch, text))
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            yield out | {"score": score, "predicted": [int(s >= threshold) for s in score]}

        return each

    return in_batches(given, schema, make)
