"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is cut into
blocks, so that the dictionary matters everywhere in it and not only at its start; each block is compressed with both.
With g and b the sums of compressed sizes over all blocks of the whole text, d = (g - b) / (g + b) is the normalised
difference, and a logistic fit on held-out labelled texts, weighted to the shares of the classes among all labels,
turns it into P(good).

With `toxic_z`, toxic texts are rejected too. A few insults in fluent prose don't change how it compresses, so toxic texts are told by words: `marks` are the words that
are in at least three labelled toxic texts and in so many more of them than by chance that z > `toxic_z`. score = P(good)
times the share of texts labelled not toxic among the labelled ones that hold a mark, if the text holds one. Texts labelled
toxic aren't examples of good ones. With fewer than `least` labelled texts toxic or not there are no marks.

Defined results: a null or blank text has score 0.0 and is rejected. With fewer than `least` labelled texts of either
class there is nothing to fit: every text that isn't blank is accepted with a null score. Labels that are null, of
unknown documents, or contradictory for one document are ignored. Rows are judged one by one, so repeated rows get
equal results and extra columns are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import batches

#: Of the queries and the pipeline.
TOXIC_Z = 6.0


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    block: int
    level: int
    raw: bool = False
    marks: np.ndarray | None = None  # hashes of words
    clean: float = 1.0  # share of texts that aren't toxic among those with a mark


def blocks(text: str, size: int) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + size] for i in range(0, len(data), size)]


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, size: int) -> float:
    own = blocks(text, size)
    g = sum(len(good.compress(x)) for x in own)
    b = sum(len(bad.compress(x)) for x in own)
    return (g - b) / (g + b)


def labelled(docs: DataFrame, labels: DataFrame, per_class: int, name: str = "quality") -> tuple[list, dict]:
    """At most per_class texts of each class of the label, those with the least hash of doc_id, and the counts of all labels."""
    own = (
        labels.select(F.col("doc_id").alias("i"), F.col(name).alias("q"))
        .where("i is not null and q in (0, 1)")
        .groupBy("i")
        .agg(F.min("q").alias("q"), F.max("q").alias("r"))
        .where("q = r")
    )
    counts = {r["q"]: r["count"] for r in own.groupBy("q").count().collect()}
    picked = own.where("q = 0").orderBy(F.xxhash64("i"), "i").limit(per_class).union(own.where("q = 1").orderBy(F.xxhash64("i"), "i").limit(per_class))
    # At most 2 * per_class ids are broadcast.
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where(F.trim("t") != "").join(F.broadcast(picked.select("i", "q")), "i")
    return sorted((r["i"], r["t"], r["q"]) for r in texts.groupBy("i").agg(F.min("t").alias("t"), F.first("q").alias("q")).collect()), counts


def held(texts: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the words."""
    out = np.zeros(len(texts), bool)
    for base, part in X.chunks(texts):
        offsets, h = X.words(part)
        out[base + X.owners(offsets)[np.isin(h, marks)]] = True
    return out


def toxic_marks(rows: list, least: int, z: float) -> tuple[np.ndarray | None, float]:
    """Words that tell toxic texts, and the share of texts that aren't among those that hold one. rows: id, text, 1 for toxic."""
    y = np.array([q for _, _, q in rows], bool)
    if min(y.sum(), (~y).sum()) < least:
        return None, 1.0
    texts = pa.array([t for _, t, _ in rows], pa.string())
    names, n, a = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)  # words, texts that hold them, toxic ones of these
    for base, part in X.chunks(texts):
        offsets, h = X.words(part)
        own, code = np.unique(h, return_inverse=True)
        pairs = np.unique(code * len(part) + X.owners(offsets))
        each, toxic = np.bincount(pairs // max(1, len(part)), minlength=len(own)), y[base + pairs % max(1, len(part))]
        names, at = np.unique(np.r_[names, own], return_inverse=True)
        n = np.bincount(at, np.r_[n, each], len(names)).astype(np.int64)
        a = np.bincount(at, np.r_[a, np.bincount(pairs // max(1, len(part)), toxic, len(own))], len(names)).astype(np.int64)
    p = y.mean()
    marks = names[(a >= 3) & (a - n * p > z * np.sqrt(n * p * (1 - p)))]
    found = held(texts, marks)
    return marks, float(((found & ~y).sum() + 1) / (found.sum() + 2))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, dictionary: int = 65536, block: int = 1024, level: int = 3, least: int = 8, toxic_z: float | None = None) -> Model | None:
    """A model of quality alone, or with toxic_z of quality and toxicity, from a bounded sample: at most per_class labelled documents of each class, half of them for the dictionaries, half for the calibration."""
    rows, counts = labelled(docs, labels if toxic_z is None else labels.where("quality = 0 or coalesce(toxic, 0) <> 1"), per_class)
    if min(sum(q == k for _, _, q in rows) for k in (0, 1)) < least:
        return None
    marks, clean = (None, 1.0) if toxic_z is None else toxic_marks(labelled(docs, labels, per_class, "toxic")[0], least, toxic_z)
    made, raw = {}, False
    rest = {k: [t for _, t, q in rows if q == k][1::2] for k in (0, 1)}
    samples = {k: [b for t in [t for _, t, q in rows if q == k][::2] for b in blocks(t, block)] for k in (0, 1)}
    try:
        made = {k: zstandard.train_dictionary(dictionary, v).as_bytes() for k, v in samples.items()}
    except zstandard.ZstdError:  # too little text to train on: the whole text itself is the dictionary
        made, raw = {k: b"".join(v) for k, v in samples.items()}, True
    model = Model(made[1], made[0], 0.0, 0.0, block, level, raw)
    good, bad = compressors(model)
    x = np.array([difference(t, good, bad, block) for k in (0, 1) for t in rest[k]])
    y = np.array([float(k) for k in (0, 1) for _ in rest[k]])
    total = sum(counts.values())
    w = np.array([counts[k] / total / len(rest[k]) for k in (0, 1) for _ in rest[k]]) * len(y)
    slope, intercept = logistic(x, y, w)
    return Model(made[1], made[0], slope, intercept, block, level, raw, marks, clean)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic regression of y on x by Newton's method."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def score(text: Column, model: Model | None) -> Column:
    """P(good and not toxic) of a text; see the module for blank texts and for no model."""
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == ""
    if model is None:
        return F.when(blank, F.lit(0.0)).otherwise(F.lit(None).cast("double"))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        good, bad = compressors(model)
        d = np.array([np.nan if t is None or not t.strip() else difference(t, good, bad, model.block) for t in (x.as_py() for x in texts)], float)
        p = 1 / (1 + np.exp(-np.clip(model.slope * d + model.intercept, -30, 30)))
        if model.marks is not None and len(model.marks):
            p = np.where(held(texts, model.marks), p * model.clean, p)
        X.trimmed()
        return pa.array(np.where(np.isnan(d), 0.0, p))

    return scored(text)


def classify(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, accepted; one row for each row of docs."""
    batches(docs.sparkSession)
    return docs.select("doc_id", score(F.col("text"), model).alias("score")).select(
        "doc_id", "score", F.coalesce(F.col("score") >= threshold, F.lit(True)).alias("accepted")
    )


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns."""
    batches(docs.sparkSession)
    return docs.where(F.coalesce(score(docs["text"], model) >= threshold, F.lit(True)))
