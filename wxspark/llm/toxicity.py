"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed insult lexicon and of a lexicon learned from labelled rows, nearness of the
second person to lexicon words, capitals, shouted words, exclamation and question marks, other punctuation and obfuscated words.
Trees learn on labelled rows, a part of which is set aside to calibrate. Both samples are bounded by SAMPLE rows, the only
bound here: every row of the corpus is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import sheltered
from wxspark.session import stored

#: Most labelled rows that trees and calibration may use, taken by a hash of the id.
SAMPLE = 40_000
#: Share of the sample's size that a bound on the hash lets through before the sample is cut to size.
SPARE = 1.25
#: Most words of the learned lexicon, and the least documents of the sample a word must be in.
LEARNED, LEAST_DOCS = 200, 5
#: Words within this distance of a lexicon word count as near it.
NEAR = 5
TREES, DEPTH = 30, 3
#: Columns added on the way, apart from those of any table.
VECTOR, RAW, MARGIN, STEP, SCORE = "_tox_vector", "_tox_raw", "_tox_margin", "_tox_step", "_tox_score"

#: Fixed value: common English insults, in the forms they are matched (lower case, letters only).
INSULTS = (
    "idiot idiots stupid moron morons dumb loser losers scum trash garbage pathetic disgusting worthless clown clowns fool "
    "fools jerk jerks creep freak filth filthy vermin pig pigs imbecile cretin coward liar ugly hate hateful shut kill"
).split()
SECOND_PERSON = "you your yours yourself u ur youre du dein deine dich dir tu te ton ta toi vous votre tus ti usted".split()
#: Fixed value: characters that stand in for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}

FEATURES = (
    "insults", "insult_share", "learned", "learned_share", "second_person_share", "near_second_person", "near_share",
    "capital_share", "shouted_share", "exclaimed_share", "asked_share", "punctuation_share", "obfuscated_share", "obfuscated_insults", "log_words",
)


def words_of(text: str) -> list[str]:
    """Lower-case words with outer punctuation removed."""
    return [w.strip(".,;:!?\"'()[]{}<>-_*~") for w in text.lower().split()]


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """FEATURES of a whole text; all zero for a null or empty one."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    insults, person = _SETS
    hits = [i for i, w in enumerate(words) if w in insults]
    weights = [learned[w] for w in words if w in learned]
    persons = np.array([i for i, w in enumerate(words) if w in person])
    known = np.array(sorted({*hits, *(i for i, w in enumerate(words) if w in learned)}), np.int64)
    near = 0
    if len(persons) and len(known):
        right = np.searchsorted(persons, known)
        gap = np.minimum(np.abs(persons[np.minimum(right, len(persons) - 1)] - known), np.abs(persons[np.maximum(right - 1, 0)] - known))
        near = int((gap <= NEAR).sum())
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(codes, minlength=256)
    size = len(codes)
    capitals = counts[65:91].sum()
    # A word is obfuscated if digits or signs stand between its letters; signs at its ends were stripped.
    odd = [w for w in words if len(w) > 2 and not w.isalpha() and any(c in LOOKALIKES for c in w) and any(c.isalpha() for c in w)]
    plain = ["".join(LOOKALIKES.get(c, c) for c in w) for w in odd]
    masked = sum(w in insults or w in learned for w in plain)
    return [
        float(len(hits)), len(hits) / n, float(sum(weights)), sum(weights) / n, len(persons) / n, float(near), near / n,
        capitals / size, sum(w.isupper() and len(w) > 2 for w in text.split()) / n, counts[33] / size, counts[63] / size,
        (counts[34:48].sum() + counts[58:63].sum() + counts[64]) / size, len(odd) / n, float(masked), float(np.log1p(n)),
    ]


_SETS = (frozenset(INSULTS), frozenset(SECOND_PERSON))


def with_features(rows: DataFrame, learned: dict[str, float]) -> DataFrame:
    """``rows`` with the FEATURES of their text as a vector column."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, learned) for t in texts])

    return rows.withColumn(VECTOR, array_to_vector(of(F.col("text").cast("string"))))


def learn_words(rows: DataFrame) -> dict[str, float]:
    """Weights of words that occur in far more toxic than clean documents of the labelled ``rows`` (text, label).

    Document frequencies are counted in a distributed way; only the LEARNED strongest words come back. A word counts if its
    log-odds are at least 3 and it lies in at least LEAST_DOCS documents.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [(w, y) for t, y in zip(frame["text"], frame["label"]) for w in {*words_of(t or "")} if len(w) > 2]
            yield pd.DataFrame(pairs, columns=["word", "label"])

    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(totals) < 2:
        return {}
    counts = rows.mapInPandas(each, "word string, label int").groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    odds = F.log(((F.col("t") + 0.5) / (totals[1] + 1)) / ((F.col("c") + 0.5) / (totals[0] + 1)))
    best = counts.withColumn("odds", odds).where(f"t + c >= {LEAST_DOCS} and odds >= 3").orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(LEARNED)
    return {r["word"]: float(r["odds"]) for r in best.select("word", "odds").collect()}


class Scorer:
    """Trees and calibration, or a constant when the training rows hold one class only."""

    def __init__(self, learned: dict[str, float], trees: GBTClassificationModel | None, steps: IsotonicRegressionModel | None, constant: float):
        self.learned, self.trees, self.steps, self.constant = learned, trees, steps, constant

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column SCORE from 0 to 1; it depends on the column text alone."""
        if self.trees is None:
            return rows.withColumn(SCORE, F.lit(self.constant))
        raw = _margins(self.trees, with_features(rows, self.learned))
        plain = 1 / (1 + F.exp(-2 * F.col(MARGIN)))
        if self.steps is None:
            return raw.withColumn(SCORE, plain).drop(MARGIN)
        # Calibrated probabilities are steps; a hundredth of the uncalibrated one keeps the order within a step.
        out = self.steps.transform(raw)
        blend = 0.99 * F.col(STEP) + 0.01 * plain
        kept = F.when(F.col(STEP) >= 0.5, F.greatest(F.lit(0.5), blend)).otherwise(F.least(F.lit(0.4999), blend))
        return out.withColumn(SCORE, F.greatest(F.least(kept, F.lit(1.0)), F.lit(0.0))).drop(MARGIN, STEP)


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn(MARGIN, vector_to_array(RAW)[1]).drop(VECTOR, RAW, "_tox_probability", "_tox_prediction")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit on at most ``sample`` labelled documents. ``labels``: doc_id, label (0 or 1); other labels and unknown ids are left out.

    Ids are compared as text. An id with several labels counts with each of them.
    """
    known = labels.where("label in (0, 1)").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null")
    total, place = known.count(), F.xxhash64("doc_id")
    if total > SPARE * sample:
        # Hashes are spread evenly: those below this bound hold a little more than the sample, so one task sorts few rows.
        known = known.where(place < int(-(2**63) + 2**64 * SPARE * sample / total))
    chosen = stored(known.orderBy(place, "doc_id", "label").limit(sample), "labels")
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(texts.join(F.broadcast(chosen), "doc_id"), "labelled")  # at most ``sample`` ids
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    learned = learn_words(rows.where(~calibrating).select("text", "label"))
    table = stored(with_features(rows.select("text", "label", calibrating.alias("later")), learned).drop("text"), "features").coalesce(4)
    counts = {(r["later"], r["label"]): r["count"] for r in table.groupBy("later", "label").count().collect()}
    if not (counts.get((False, 0)) and counts.get((False, 1))):
        n = sum(counts.values())
        return Scorer(learned, None, None, sum(v for (_, y), v in counts.items() if y) / n if n else 0.0)
    learner = GBTClassifier(featuresCol=VECTOR, labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64)
    learner = learner.setRawPredictionCol(RAW).setProbabilityCol("_tox_probability").setPredictionCol("_tox_prediction")
    trees = learner.fit(table.where("not later"))
    steps = None
    if counts.get((True, 0)) and counts.get((True, 1)):
        margins = _margins(trees, table.where("later")).withColumn("label", F.col("label").cast("double"))
        steps = IsotonicRegression(featuresCol=MARGIN, labelCol="label", predictionCol=STEP).fit(margins)
    return Scorer(learned, trees, steps, 0.0)


def held_out(doc_id: str):
    """Rows whose label is never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with a column SCORE, learned from the rows of ``labels`` (doc_id, toxic) that are not held out.

    Null and empty texts are scored as texts without any feature. Other columns are kept, whatever their names, and not looked at; one called
    SCORE is replaced.
    """
    learnable = labels.where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("label"))
    return sheltered(docs, ("doc_id", "text"), train(docs, learnable, sample).score, adds=(SCORE,))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(documents.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
