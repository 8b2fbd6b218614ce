"""Quality classifier by compression (operator 1).

Labelled texts are dealt to ``FOLDS`` folds.  For each fold two zstandard
dictionaries are trained from the good and the bad texts of the other folds.  A whole
text is cut into blocks and each block is compressed with either dictionary; the
difference of the summed sizes, beyond the noise of ``NOISE_BYTES`` a block and normalised by the geometric mean of the text's length
and those sizes, tells which dictionary knows the text better.  So every labelled
text trains dictionaries and, measured by the pair that hasn't seen it, the curve.  A
new text's difference is the mean over all pairs.

The score is a logistic curve of the difference with a slope of its own on either
side of 0, both at least ``LEAST_SLOPE``: a larger difference never scores lower.  It is
fitted to the held-out differences, weighted to the shares of the classes among all
labels.  A text that compresses itself, such as one word over and over, has a
difference near 0, as neither dictionary is needed for it; an empty one has 0.  Such
texts have no content to be good by, so the curve's value at 0 is below 0.5 at every size
of the sample: its logit is at most ``FOOT``.

Blocks keep the dictionaries at work to the end of a long text, where a single
frame would compress a text with its own beginning.

Labels: rows with null doc_id or quality are ignored, and so are documents whose
rows contradict each other.  The fit takes at most ``fit_docs`` documents of
each class, those of the smallest hashes, and of these as many as have
``FIT_BYTES`` bytes together (of several texts of one id, the smallest); every
text is scored.  Null and empty texts have difference 0.  With fewer than two texts of a
class, and where the good dictionaries don't do better on good texts, no
curve is to be had: every score is the smoothed share of label 1.  Texts of any
length are scored whole; repeated rows stay; extra columns play no part, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, table, texts_of, tidied

#: Most labelled documents of each class that are fitted.
FIT_DOCS = 2000
#: Most bytes of a class that are fitted.
FIT_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2 << 10
LEVEL = 3
FOLDS = 3
#: Most logit of a text of difference 0, and least slope of the curve on either side.
FOOT, LEAST_SLOPE = -0.25, 0.05


#: Bytes that lengths and sizes are raised by, so that very short texts stay undecided.
STEADY_BYTES = 64
#: Bytes of a block by which sizes may differ though the dictionaries know it equally well.
NOISE_BYTES = 4


def blocks_of(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


@dataclass
class Classifier:
    """Pairs of dictionaries (good, bad), and the curve: spread of the differences, slopes above and below 0, foot."""

    spread: float
    up: float
    down: float
    foot: float
    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    block: int = BLOCK_BYTES
    level: int = LEVEL

    def measure(self):
        """A function from a text to its normalised size difference, positive where the good dictionaries do better."""
        import zstandard

        def compressor(raw: bytes):
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False).compress

        if not self.pairs:
            return lambda text: 0.0
        pairs = [(compressor(good), compressor(bad)) for good, bad in self.pairs]

        def difference(text: bytes) -> float:
            blocks, out = blocks_of(text, self.block), 0.0
            for pair in pairs:
                g, b = (sum(len(size(x)) for x in blocks) - FRAME_BYTES * len(blocks) for size in pair)
                beyond = max(0, abs(b - g) - NOISE_BYTES * len(blocks))
                out += math.copysign(beyond, b - g) / math.sqrt((len(text) + STEADY_BYTES) * (b + g + STEADY_BYTES))
            return out / len(pairs)

        return difference

    def scores(self, differences: np.ndarray) -> np.ndarray:
        z = differences / self.spread
        return 1 / (1 + np.exp(-np.clip(np.maximum(z, 0) * self.up + np.minimum(z, 0) * self.down + self.foot, -700, 700)))


#: Bytes of a frame that hold no text.
FRAME_BYTES = 5


def train_dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """A dictionary of the texts' blocks; where they are too few to train one, their bytes as they are."""
    import zstandard

    samples = [b for text in texts for b in blocks_of(text, block)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, k=512, d=8, steps=0).as_bytes() if len(samples) >= 20 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float, float]:
    """Spread of the numbers, and the slopes and foot of the likeliest curve within the bounds.

    The likelihood has one top, so of the fits with some of the three at their bounds the
    best that keeps all bounds is it; each is found by Newton's method.
    """
    spread = float(x.std()) or 1.0
    z = np.stack([np.maximum(x, 0) / spread, np.minimum(x, 0) / spread, np.ones(len(x))], 1)
    bounds, best = np.array([LEAST_SLOPE, LEAST_SLOPE, FOOT]), None
    for bound in itertools.product((False, True), repeat=3):
        free = ~np.array(bound)
        w = bounds.copy()
        for _ in range(60 if free.any() else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = (z.T @ (weight * (y - p)) - ridge * w)[free]
            step = np.linalg.solve(((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(3))[np.ix_(free, free)], slope)
            w[free] += step
            if np.abs(step).max() < 1e-9:
                break
        if w[0] < LEAST_SLOPE or w[1] < LEAST_SLOPE or w[2] > FOOT:
            continue
        likely = -(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ w))).sum() - ridge / 2 * (w @ w)
        if best is None or likely > best[0]:
            best = (likely, w)
    return spread, *map(float, best[1])


def pair_of(texts: dict[int, list[bytes]]) -> tuple[bytes, bytes]:
    """Dictionaries of the good and the bad texts; both get as many bytes, or the richer one would win everywhere."""
    budget, parts = min(sum(map(len, own)) for own in texts.values()), {}
    for q, own in texts.items():
        parts[q], left = [], budget
        for text in own:
            if left <= 0:
                break
            parts[q].append(text[:left])
            left -= len(text)
    return train_dictionary(parts[1], DICTIONARY_BYTES, BLOCK_BYTES), train_dictionary(parts[0], DICTIONARY_BYTES, BLOCK_BYTES)


def held_out(by_class: dict[int, list[bytes]], folds: int) -> tuple[list[tuple[bytes, bytes]], np.ndarray, np.ndarray]:
    """Pairs of dictionaries, one for each fold left out, and difference and quality of each text by the pair that hasn't seen it."""
    pairs, differences, quality = [], [], []
    for fold in range(folds):
        pairs.append(pair_of({q: [t for i, t in enumerate(texts) if i % folds != fold] for q, texts in by_class.items()}))
        measure = Classifier(1.0, 0.0, 0.0, 0.0, pairs[-1:]).measure()
        for q, texts in by_class.items():
            differences += [measure(t) for t in texts[fold::folds]]
            quality += [q] * len(texts[fold::folds])
    return pairs, np.array(differences), np.array(quality)


def train(examples: list[tuple[bytes, int]], shares: dict[int, int] | None = None) -> Classifier:
    """``examples``: (text, quality 0 or 1), dealt to folds by turns; ``shares``: rows of each class among all labels."""
    by_class = {q: [text for text, quality in examples if quality == q and text] for q in (0, 1)}
    shares = shares or {q: sum(quality == q for _, quality in examples) for q in (0, 1)}
    prior = (shares.get(1, 0) + 0.5) / (shares.get(0, 0) + shares.get(1, 0) + 1)
    constant = Classifier(1.0, 0.0, 0.0, float(np.log(prior / (1 - prior))))
    fewest = min(map(len, by_class.values()))
    if fewest < 2:
        return constant
    pairs, differences, quality = held_out(by_class, min(FOLDS, fewest))
    weight = np.array([shares[q] / (quality == q).sum() for q in quality])
    curve = logistic(differences, quality.astype(float), weight / weight.mean())
    return Classifier(*curve, pairs) if curve[1] > LEAST_SLOPE else constant


def sampled(docs: DataFrame, labels: DataFrame, fit_docs: int) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """At most ``fit_docs`` labelled texts of each class, by hash, and all labels' numbers; this bounded sample comes to the driver."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    order = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    picked = None
    for q in (0, 1):
        part = agreed.where(F.col("quality") == q).select("doc_id", "quality", order.alias("turn")).orderBy("turn", "doc_id").limit(fit_docs)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # 2 * fit_docs rows of three numbers: small enough to send to every task
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("turn", "doc_id", "quality").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("quality").orderBy("turn", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= FIT_BYTES).select("turn", "doc_id", "quality", "text").collect()
    shares = {int(r["quality"]): r["count"] for r in agreed.where("quality in (0, 1)").groupBy("quality").count().collect()}
    return [(r["text"].encode(), int(r["quality"])) for r in sorted(rows, key=lambda r: (r["turn"], r["doc_id"], r["text"]))], shares


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Classifier:
    return train(*sampled(docs, labels, fit_docs))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with score, predicted and difference for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("difference", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.measure()
        for batch in batches:
            texts = texts_of(batch.column(2)).cast(pa.binary())
            differences = np.array([measure(x.as_py()) for x in texts], np.float64)
            scores = model.scores(differences)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(differences)], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["held_out"], docs["text"].cast("string")).mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int, difference double")


def keep_good(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) whose text is not rejected; same columns, in one pass."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, schema = docs.columns, to_arrow_schema(docs.schema)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.measure()
        for batch in batches:
            texts = texts_of(batch.column(at)).cast(pa.binary())
            scores = model.scores(np.array([measure(x.as_py()) for x in texts], np.float64))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(scores >= 0.5)).columns, schema=schema)

    return docs.mapInArrow(tidied(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    return score(docs.select("doc_id", (crc_mod(docs["doc_id"], 3) == 1).alias("held_out"), "text"), model)
