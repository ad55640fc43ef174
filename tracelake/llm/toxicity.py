"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded text.

Folding puts a text in lower case, look-alike letters to Latin ones and digits and signs that stand for letters to
those letters, so that ``1d!0t`` and Cyrillic look-alikes meet the lexicon's plain forms. The lexicon holds whole words
and word beginnings with the log-odds of documents that have them, learned by a count over labelled documents in
Spark. Exception phrases, learned (longer words that mostly clean documents have) or given (any phrase), void the matches inside
them. The sum of the weights of what matches is normalised by the text's length and calibrated to a score.

Bound of the fit: at most ``per_class`` labelled rows of each class and ``entries`` entries of the lexicon.

Defined cases: a null text is scored as an empty one; an empty text has no match and gets the calibration's value for none;
each row gives one row; without labelled rows of both classes the score is constant, 0 if there are none.
Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import dataclasses
import math
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, read
from .fitting import fold, labelled_sample, logistic, probability

PER_CLASS = 6000
ENTRIES = 400
#: A word beginning has so many letters.
STEMS = (4, 5, 6, 7, 8)
LEAST_DOCS = 5
LEAST_LOG_ODDS = 2.5
#: Look-alikes in Cyrillic and Greek, then digits and signs that stand for letters.
FOLD_FROM = "асеорхуіјѕԁһкмтвнαεικνορτυ0134578@$!"
FOLD_TO = "aceopxyijsdhkmtbhaeiknoptuoieastbasi"
_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS = re.compile(_GAP)


def folded(text: Column) -> Column:
    """The words of a folded text, one blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), _GAP, " ")), F.lit(" "))


def fold_text(text: str) -> str:
    return f" {_GAPS.sub(' ', text.lower().translate(_TABLE)).strip(' ')} "


@dataclasses.dataclass
class ToxicityModel:
    entries: dict[str, float]
    exceptions: list[str]
    weights: np.ndarray
    constant: float | None = None

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, w in self.entries.items():
            out.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(out):
            out.make_automaton()
        return out


def _features(texts, model: ToxicityModel) -> np.ndarray:
    cues = model.automaton()
    out = np.zeros((len(texts), 4))
    for k, text in enumerate(texts):
        t = fold_text(text)
        best: dict[int, float] = {}  # by the word's place: its heaviest entry
        void = []
        for last, (n, w) in cues.iter(t) if len(cues) else ():
            at = last - n + 1
            if w is None:
                void.append((at, last))
            elif w > best.get(at, 0):
                best[at] = w
        got = [w for at, w in best.items() if not any(s <= at < e for s, e in void)] if void else list(best.values())
        total = sum(got)
        out[k] = max(got, default=0), total / math.sqrt(t.count(" ") + 20), min(total, 40) / 10, len(got) > 1
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, per_class: int = PER_CLASS, entries: int = ENTRIES, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    sample = labelled_sample(docs, labels, label, per_class=per_class)
    grams = sample.select("y", F.array_distinct(F.split(F.trim(folded(F.col("text"))), " ")).alias("w"))
    stems = [F.transform("w", lambda w, i: F.concat(F.lit(" "), w, F.lit(" ")))]
    stems += [_stem(k) for k in STEMS]
    counted = grams.select("y", F.explode_outer(F.array_distinct(F.concat(*stems))).alias("g")).where(F.length("g") > 2).groupBy("g").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    sizes = dict(sample.groupBy("y").agg(F.count("*").alias("n")).collect())
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not c:
        discard(sample)
        return ToxicityModel({}, [], np.zeros(5), 1.0 if t else 0.0)
    weight = F.log((F.col("bad") + 0.5) / (t + 1)) - F.log((F.col("good") + 0.5) / (c + 1))
    scored = counted.withColumn("w", weight)
    top = scored.where((F.col("bad") >= LEAST_DOCS) & (F.col("w") >= LEAST_LOG_ODDS)).orderBy((F.col("w") * F.sqrt("bad")).desc(), "g").limit(10 * entries).collect()
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of chosen entries
    for r in top:  # the strongest first; what only extends or shortens a chosen entry adds nothing, so variants are merged before the list is cut
        starts = {r["g"][:n] for n in range(1, len(r["g"]) + 1)}
        if len(chosen) < entries and r["g"] not in begun and not starts & chosen.keys():
            chosen[r["g"]] = float(r["w"])
            begun |= starts
    heads = [x for x in chosen if not x.endswith(" ")]
    learned = []
    if heads:
        begins = F.lit(False)
        for k in sorted({len(x) for x in heads}):
            begins = begins | F.substring("g", 1, k).isin([x for x in heads if len(x) == k])
        learned = [r["g"].strip() for r in scored.where(F.col("g").endswith(" ") & (F.col("good") >= 2) & (F.col("w") <= 0) & begins).orderBy(F.col("good").desc(), "g").limit(entries).collect()]
    model = ToxicityModel(chosen, sorted({*learned, *(fold_text(x).strip() for x in exceptions)} - {""}), np.zeros(5))
    rows = score_features(sample, model).select("y", "f").collect()
    discard(sample)
    model.weights = logistic(np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows], float), ridge=0.1)
    return model


def _stem(k: int) -> Column:
    return F.transform(F.filter("w", lambda w: F.length(w) >= k), lambda w: F.concat(F.lit(" "), F.substring(w, 1, k)))


def score_features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_features(texts, model)))

    return docs.withColumn("f", features(F.col("text")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column ``out``: how likely label 1 is for the whole text."""
    if model.constant is not None:
        return docs.withColumn(out, F.lit(model.constant))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(probability(_features(texts, model), model.weights), dtype="float64")

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    found = score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
