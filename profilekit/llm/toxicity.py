"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text becomes the hashed character n-grams of its lower-case form, in which every run of white space
is one space and a space stands before the first character, so n-grams see where words begin.
For every n-gram the ratio ``r = log(share among toxic rows / share among other rows)`` is counted on the
training sample; a logistic regression with a lasso penalty is fitted on ``log(1 + occurrences) * r`` (as
in NB-SVM). Scoring a text is one pass over its characters: hash, look the slot up, count, sum the weights.

Bounds, all parameters: ``max_rows`` labelled rows are used for training (those with the smallest
hash of their id, so the sample does not depend on partitions), ``slots`` hash slots, of which the
``features`` with the strongest evidence keep a weight. The model is therefore of fixed size
and can be broadcast; scoring covers every row and every character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import arrow_schema, give_back, id_and_text, per_text, slices
from profilekit.session import materialise

_MULTIPLIER = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
_BLOCK = 1 << 18
#: Slots are counted in blocks that 16 bits number.
_SLOT_BLOCK = 1 << 16
#: Texts become Python strings in slices of about so many bytes.
_SLICE_BYTES = 1 << 22


@dataclass(frozen=True)
class ToxicityParams:
    """Everything the fit depends on, besides the labelled rows."""

    sizes: tuple[int, ...] = (4, 5, 6, 7, 8)
    slot_bits: int = 22
    features: int = 16_384
    least_rows: int = 5
    max_rows: int = 20_000
    smoothing: float = 1.0
    penalty: float = 3e-4
    lasso: float = 1.0
    rounds: int = 60


@dataclass(frozen=True)
class ToxicityModel:
    """Weight per feature, feature per slot (0: none), intercept."""

    params: ToxicityParams
    feature_of_slot: np.ndarray
    weights: np.ndarray
    intercept: float

    def raw(self, text: str) -> float:
        found, times = feature_counts(text, self.feature_of_slot, len(self.weights), self.params)
        return float(np.log1p(times) @ self.weights[found] + self.intercept)

    def score(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(text), -700, 700))))


def ngram_slots(text: str, params: ToxicityParams):
    """Slots of the text's n-grams, block by block; blocks overlap, so no n-gram is lost."""
    text = " " + " ".join(text.lower().split())
    shift, longest = np.uint32(32 - params.slot_bits), max(params.sizes)
    for start in range(0, len(text), _BLOCK):
        codes = np.frombuffer(text[start:start + _BLOCK + longest - 1].encode("utf-32-le"), np.uint32)
        value = codes
        for size in range(2, longest + 1):
            if len(codes) < size:
                break
            value = value[:-1] * _MULTIPLIER + codes[size - 1:]
            if size in params.sizes:
                yield (value[:_BLOCK] * _SPREAD) >> shift


def feature_counts(text: str, feature_of_slot: np.ndarray, width: int, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """(features, occurrences of each in the whole text); entry 0 stands for no feature and is left out."""
    counts = np.zeros(width, np.int64)
    for slots in _per_block(ngram_slots(text, params), params):
        counts += np.bincount(feature_of_slot[slots], minlength=width)
    counts[0] = 0
    found = np.flatnonzero(counts)
    return found, counts[found]


def _per_block(slots, params: ToxicityParams):
    """Slots of all sizes of one block together."""
    held = []
    for found in slots:
        if held and len(held) == len(params.sizes):
            yield np.concatenate(held)
            held = []
        held.append(found)
    if held:
        yield np.concatenate(held)


def held_out(doc_id):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """(doc_id, text, toxic) of at most ``max_rows`` labelled rows that are not held out.

    The labels are cut before the join, so what is broadcast has at most ``max_rows`` rows. A row whose labels contradict
    each other counts as toxic.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_rows)
    )
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")


_COUNT_DDL = "block int, toxic int, slots binary, counts binary"
_BEST_DDL = "slot int, ratio double, evidence double"


def slot_counts(sample: DataFrame, params: ToxicityParams) -> DataFrame:
    """(block, toxic, slots, counts): in how many sample rows of a class a slot occurs, added up per task, in arrays per block."""

    def count(batches):
        import pyarrow as pa

        counts = np.zeros((2, max(_SLOT_BLOCK, 1 << params.slot_bits)), np.int32)
        for batch in batches:
            classes = batch.column("toxic").to_pylist()
            for start, texts in slices(batch, most=_SLICE_BYTES):
                for text, toxic in zip(texts, classes[start:start + len(texts)]):
                    mine = counts[int(toxic > 0)]
                    parts = list(_per_block(ngram_slots(text, params), params))
                    if len(parts) == 1:
                        mine[parts[0]] += 1  # a slot that stands there several times is set once
                    elif parts:
                        seen = np.zeros(mine.shape, bool)
                        for slots in parts:
                            seen[slots] = True
                        mine += seen
        schema = pa.schema([("block", pa.int32()), ("toxic", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])
        for toxic in (0, 1):
            for block, part in enumerate(counts[toxic].reshape(-1, _SLOT_BLOCK)):
                found = np.flatnonzero(part)
                if len(found):
                    yield pa.RecordBatch.from_pydict({
                        "block": [block], "toxic": [toxic], "slots": [found.astype(np.uint16).tobytes()], "counts": [part[found].tobytes()]}, schema=schema)

    return sample.select("text", "toxic").mapInArrow(count, _COUNT_DDL)


def strongest_slots(sample: DataFrame, sizes: tuple[int, int], params: ToxicityParams):
    """Arrow table (slot, ratio, evidence) of the ``features`` slots with the strongest evidence, the smaller slot first at ties."""
    a, n_good, n_bad = params.smoothing, *sizes

    def judge(frame):
        import pandas as pd

        counts = np.zeros((2, _SLOT_BLOCK), np.int64)
        for toxic, slots, times in zip(frame["toxic"], frame["slots"], frame["counts"]):
            counts[int(toxic)][np.frombuffer(slots, np.uint16)] += np.frombuffer(times, np.int32)
        good, bad = counts
        slot = np.flatnonzero(good + bad >= params.least_rows)
        good, bad = good[slot], bad[slot]
        ratio = np.log((a + bad) / (2 * a + n_bad)) - np.log((a + good) / (2 * a + n_good))
        evidence = np.abs(ratio) * np.sqrt(bad + good)
        best = np.lexsort((slot, -evidence))[:params.features]
        first = int(frame["block"].iat[0]) * _SLOT_BLOCK
        return pd.DataFrame({"slot": (slot[best] + first).astype(np.int32), "ratio": ratio[best], "evidence": evidence[best]})

    candidates = materialise(slot_counts(sample, params).groupBy("block").applyInPandas(judge, _BEST_DDL))
    # Counts by rounded evidence tell from where on the wanted number is reached; only that much is read.
    level = F.floor(F.col("evidence") * 4)
    left, cut = params.features, 0
    for row in candidates.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        cut, left = row["level"], left - row["count"]
        if left <= 0:
            break
    best = candidates.where(level >= cut).toArrow()
    return best.sort_by([("evidence", "descending"), ("slot", "ascending")]).slice(0, params.features)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on the training sample. Without rows of both classes every text gets the smoothed share of toxic rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    sample = materialise(training_sample(docs, labels, params))
    sizes = {0: 0, 1: 0}
    for row in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect():
        sizes[row["toxic"]] += row["count"]
    if params.features >= 1 << 16:
        raise ValueError("at most 65,535 features")
    feature_of_slot = np.zeros(1 << params.slot_bits, np.uint16)
    if not (sizes[0] and sizes[1]):
        prior = (sizes[1] + 1) / (sizes[0] + sizes[1] + 2)
        return ToxicityModel(params, feature_of_slot, np.zeros(1), float(np.log(prior / (1 - prior))))

    best = strongest_slots(sample, (sizes[0], sizes[1]), params)
    feature_of_slot[best["slot"].to_numpy()] = np.arange(1, best.num_rows + 1)
    scale = np.r_[0.0, best["ratio"].to_numpy()]
    width = len(scale)

    shared = sample.sparkSession.sparkContext.broadcast((feature_of_slot, scale))

    def make():
        table, _ = shared.value

        def work(doc_ids, texts):
            found, times = [], []
            for text in texts:
                features, counts = feature_counts(text, table, width, params)
                found.append(features.astype(np.int32))
                times.append(counts.astype(np.int32))
            return {"toxic": doc_ids, "found": found, "times": times}

        return work

    found = materialise(per_text(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), make, "toxic long, found array<int>, times array<int>"))
    to_vector = F.udf(lambda at, times: Vectors.sparse(width, at, (np.log1p(times) * shared.value[1][at]).tolist()), VectorUDT())
    rows = found.select((F.col("toxic") > 0).cast("double").alias("label"), to_vector("found", "times").alias("features"))
    model = LogisticRegression(maxIter=params.rounds, regParam=params.penalty, elasticNetParam=params.lasso, standardization=False).fit(rows)
    shared.unpersist()
    weights = np.asarray(model.coefficients.toArray()) * scale
    # The lasso leaves most features without weight; scoring need not count them.
    kept = np.r_[0, np.flatnonzero(weights)]
    place = np.zeros(width, np.uint16)
    place[kept] = np.arange(len(kept))
    return ToxicityModel(params, place[feature_of_slot], weights[kept], float(model.intercept))


def score_texts(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text.

    Defined cases: null is the empty text, which gets the score of the intercept, as does any text shorter
    than the shortest n-gram; repeated rows get equal scores; other columns are ignored; an
    empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, score double, predicted int"

    def run(batches):
        import pyarrow as pa

        fitted = shared.value
        for batch in batches:
            for start, texts in slices(batch, most=_SLICE_BYTES):
                scores = [fitted.score(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=arrow_schema(ddl))

    return id_and_text(df, id_col, text_col).mapInArrow(run, ddl)


def drop_toxic(df: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``df`` that the classifier does not reject, with all their columns.

    Scores are computed beside the rows in one pass, so nothing is joined back: rows
    without an id and repeated rows are judged by their text like any other.
    """
    model = fit(df, labels, params)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        import pyarrow as pa

        fitted = shared.value
        for batch in batches:
            for start, texts in slices(batch, most=_SLICE_BYTES):
                yield batch.slice(start, len(texts)).filter(pa.array([fitted.score(t) < 0.5 for t in texts], pa.bool_()))
        give_back()

    return df.mapInArrow(keep, df.schema)
