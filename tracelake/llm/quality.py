"""Quality by compression: a text looks like the class whose dictionary compresses it better.

Two zstandard dictionaries are built from good and bad labelled texts: whole texts of the class, in the order of a hash, up to ``dict_size`` bytes, as many for either class. Each whole text is compressed with both. The
difference of the two sizes, divided by the text's size and by the lesser of the two, becomes a score through a logistic calibration fitted on training texts that the dictionaries did not
see; nothing else enters it.

Bound of the fit: at most ``per_class`` labelled rows of each class, of which those over ``max_text`` bytes are left out
of the fit (never of the scoring); the model is two dictionaries of ``dict_size`` bytes and three weights.

Defined cases: a null text is scored as an empty one, which gets the calibration's value for an empty text; each row
gives one row; without labelled rows of both classes every score is the share of label 1 among them (0.5 without any).
Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read
from .fitting import fold, labelled_sample, logistic, probability

PER_CLASS = 1500
MAX_TEXT = 20_000
DICT_SIZE = 524_288
LEVEL = 6


@dataclasses.dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    constant: float | None = None


def _packer(texts: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(texts, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)


def _differences(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """How much better each text is packed with the good dictionary than with the bad one, by its own size and by its packed size."""
    packers = [_packer(d) for d in (good, bad)]
    out = np.empty((len(texts), 2))
    for k, t in enumerate(texts):
        a, b = (len(p.compress(t)) for p in packers)
        out[k] = (b - a) / (len(t) + 20) * 10, (b - a) / min(a, b)
    return out


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """Whole texts in the order of a hash, as many as fit; a blank where there is none."""
    out, n = [], 0
    for t in sorted(texts, key=lambda t: (zlib.crc32(b"x" + t), t)):
        if n + len(t) < size:
            out.append(t)
            n += len(t) + 1
    return b"\n".join(out) or b" " * 8


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", *, per_class: int = PER_CLASS, max_text: int = MAX_TEXT, dict_size: int = DICT_SIZE) -> QualityModel:
    sample = labelled_sample(docs, labels, label, per_class=per_class)
    rows = sample.where(F.octet_length("text") <= max_text).select("text", "y").collect()  # at most 2 * per_class
    discard(sample)
    texts = sorted({(r["text"].encode(), r["y"]) for r in rows})
    y = np.array([v for _, v in texts], float)
    if len(set(y)) < 2:
        return QualityModel(b"", b"", np.zeros(3), float(y.mean()) if len(y) else 0.5)
    # Three quarters build the dictionaries, the rest calibrates.
    held = np.array([zlib.crc32(t) % 4 == 0 for t, _ in texts])
    built = {v: [t for (t, x), h in zip(texts, held, strict=True) if x == v and not h] for v in (0, 1)}
    even = min(dict_size, *(sum(map(len, built[v])) + len(built[v]) + 1 for v in (0, 1)))  # a larger dictionary packs anything better
    bad, good = (_dictionary(built[v], even) for v in (0, 1))
    use = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    x = _differences([t for (t, _), u in zip(texts, use, strict=True) if u], good, bad)
    return QualityModel(good, bad, logistic(x, y[use], ridge=0.1))


def score_quality(docs: DataFrame, model: QualityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column ``out``: how likely label 1 is for the whole text."""
    if model.constant is not None:
        return docs.withColumn(out, F.lit(model.constant))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(probability(_differences([t.encode() for t in texts], model.good, model.bad), model.weights), dtype="float64")

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    found = score_quality(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
