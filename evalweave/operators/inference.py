"""Cluster bootstrap, confidence limits, paired tests, multiple comparisons and ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import chi2_tail
from ..sources.storage import written
from . import draws
from .metrics import with_prediction

LEVELS = (0.025, 0.975)
METRICS = ("acc", "bal_acc", "f1_weighted", "qwk", "auc")
#: Groups whose weights in all replicates a task holds, rows that it holds for each of them where groups are few, and rows that are weighed at a time.
HELD_ROWS, HELD_MORE, WEIGHED_ROWS = 5000, 5, 1024
# Upper 5 % points of the studentised range over the square root of 2, for 2 to 10 models.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def effective_groups(predictions: DataFrame) -> DataFrame:
    """Groups of a dataset whose groups are all empty are its rows."""
    none = predictions.groupBy("dataset").agg(F.max(F.coalesce(F.col("grp"), F.lit("")) != "").alias("grouped"))
    return predictions.join(none, "dataset").withColumn("grp", F.when(F.col("grouped"), F.col("grp")).otherwise(F.col("row_id").cast("string"))).drop("grouped")


def resamples(predictions: DataFrame, replicates: int) -> DataFrame:
    """dataset, seed, b, grp, w: the groups of each replicate, as often as they were drawn."""
    schema = pa.schema([("dataset", pa.string()), ("seed", pa.int64()), ("b", pa.int32()), ("grp", pa.string()), ("w", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = np.frombuffer(batch.column(3)[i].as_buffer(), "<u4")
                some = np.flatnonzero(w)
                keys = [pa.array([batch.column(k)[i].as_py()] * len(some), schema.field(name).type) for k, name in enumerate(("dataset", "seed", "grp"))]
                yield pa.RecordBatch.from_arrays([keys[0], keys[1], pa.array(some + 1, pa.int32()), keys[2], pa.array(w[some].astype(np.float64))], schema=schema)

    found = draws.resampled(predictions, replicates).mapInArrow(run, "dataset string, seed long, b int, grp string, w double")
    return found.withColumn("seed", F.col("seed").cast(predictions.schema["seed"].dataType))


def weights_of(weights: pa.Table) -> np.ndarray:
    """A row for each group: 1 for replicate 0, the point estimate, then its weights in the replicates."""
    w = np.frombuffer(b"".join(weights.column("weights").to_pylist()), "<u4").reshape(weights.num_rows, -1)
    return np.concatenate((np.ones((len(w), 1), "<u4"), w), 1)


def groups_of(rows: pa.Table, weights: pa.Table) -> np.ndarray:
    """Each row's group's place among the weights."""
    return pc.index_in(rows.column("grp"), value_set=weights.column("grp").combine_chunks()).to_numpy()


def confusion_metrics(counts: np.ndarray) -> dict[str, np.ndarray]:
    """acc, bal_acc, f1_weighted and qwk of each replicate; ``counts`` by replicate, target and prediction.  Undefined values are NaN."""
    row, col = counts.sum(2), counts.sum(1)
    hit = np.einsum("bii->bi", counts)
    n = row.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        f1 = np.where(row + col > 0, 2 * hit / (row + col), 0)
        recall = np.where(row > 0, hit / row, 0)
        # QWK counts positions among the labels that occur in the replicate
        at = np.cumsum(row + col > 0, 1) - 1.0
        apart = (at[:, :, None] - at[:, None, :]) ** 2
        expected = np.einsum("bi,bj,bij->b", row, col, apart)
        qwk = 1 - np.where(expected > 0, (counts * apart).sum((1, 2)) * n / expected, np.nan)
        return {"acc": hit.sum(1) / n, "bal_acc": recall.sum(1) / (row > 0).sum(1), "f1_weighted": (f1 * row).sum(1) / n, "qwk": qwk}


def confusion_values(cells: DataFrame, weights: DataFrame, blocks: int) -> DataFrame:
    """dataset, seed, model, metric, values (a number for each replicate) of cells (grp, target, pred, n).

    Groups are dealt to blocks, so a group's weights are sent to one task, once.
    """

    def part(rows: pa.Table, weights: pa.Table) -> pa.Table:
        schema = pa.schema([("dataset", pa.string()), ("seed", pa.int64()), ("model", pa.string()), ("target", pa.int64()), ("pred", pa.int64()), ("total", pa.binary())])
        if not rows.num_rows:
            return schema.empty_table()
        w, group, n = weights_of(weights), groups_of(rows, weights), rows.column("n").to_numpy()
        models = pc.dictionary_encode(rows.column("model").combine_chunks())
        labels = np.stack([models.indices.to_numpy().astype(np.int64), *(rows.column(c).to_numpy() for c in ("target", "pred"))], 1)
        found, back = np.unique(labels, axis=0, return_inverse=True)
        back, total = back.ravel(), np.zeros((len(found), w.shape[1]))
        for at in range(0, len(n), WEIGHED_ROWS):
            now = slice(at, at + WEIGHED_ROWS)
            np.add.at(total, back[now], w[group[now]] * n[now].astype(np.float64)[:, None])
        keys = [pa.array([rows.column(c)[0].as_py()] * len(found), schema.field(c).type) for c in ("dataset", "seed")]
        return pa.Table.from_arrays([*keys, models.dictionary.take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array([t.tobytes() for t in total], pa.binary())], schema=schema)

    def whole(rows: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(rows.column("total").to_pylist()), "<f8").reshape(rows.num_rows, -1)
        target, pred = (rows.column(c).to_numpy() for c in ("target", "pred"))
        labels = np.unique(np.concatenate((target, pred)))
        counts = np.zeros((total.shape[1], len(labels), len(labels)))
        np.add.at(counts, (slice(None), np.searchsorted(labels, target), np.searchsorted(labels, pred)), total.T)
        found = confusion_metrics(counts)
        keys = {c: [rows.column(c)[0].as_py()] * len(found) for c in ("dataset", "seed", "model")}
        return pa.table({**keys, "metric": list(found), "values": pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))})

    cells, weights = (t.withColumn("block", F.pmod(F.xxhash64("grp"), F.lit(blocks))).groupBy("dataset", "seed", "block") for t in (cells, weights))
    parts = cells.cogroup(weights).applyInArrow(part, "dataset string, seed long, model string, target long, pred long, total binary")
    return parts.groupBy("dataset", "seed", "model").applyInArrow(whole, "dataset string, seed long, model string, metric string, values array<double>")


def in_ranges(scores: DataFrame, blocks: int) -> DataFrame:
    """Adds bucket: which of ``blocks`` ranges of its data set's and seed's scores a score lies in, by a table of bounds."""
    shares = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
    ends = scores.groupBy("dataset", "seed").agg(F.percentile_approx("score", shares, 10 * blocks).alias("ends")).collect() if blocks > 1 else []  # a row for each unit
    bounds = {(r["dataset"], r["seed"]): np.array(r["ends"]) for r in ends}
    columns, names = [scores.columns.index(c) for c in ("dataset", "seed", "score")], [*scores.columns, "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dataset, seed, score = (batch.column(c) for c in columns)
            score, bucket = score.to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32)
            for (d, s), known in bounds.items():
                own = pc.and_(pc.equal(dataset, d), pc.equal(seed, s)).to_numpy(zero_copy_only=False)
                bucket[own] = np.searchsorted(known, score[own], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], names=names)

    return scores.mapInArrow(run, T.StructType([*scores.schema.fields, T.StructField("bucket", T.IntegerType())]))


def side_sums(group: np.ndarray, n: np.ndarray, score: np.ndarray, positive: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pos, neg and wins of each replicate, of rows in order of scores; some rows are weighed at a time, and equal scores are carried on."""
    below, wins, pos_sum = (np.zeros(w.shape[1]) for _ in range(3))
    last, open_ = None, np.zeros((2, w.shape[1]))
    for at in range(0, len(n), WEIGHED_ROWS):
        now = slice(at, at + WEIGHED_ROWS)
        x, s = w[group[now]] * n[now].astype(np.float64)[:, None], score[now]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        pos, neg = (np.add.reduceat(np.where(side[:, None], x, 0), first) for side in (positive[now], ~positive[now]))
        if last is not None and s[0] == last:
            pos[0] += open_[0]
            neg[0] += open_[1]
        elif last is not None:
            pos, neg = np.concatenate((open_[:1], pos)), np.concatenate((open_[1:], neg))
        last, open_ = s[-1], np.stack((pos[-1], neg[-1]))
        pos, neg = pos[:-1], neg[:-1]
        wins += (pos * (below + np.cumsum(neg, 0) - neg / 2)).sum(0)
        below += neg.sum(0)
        pos_sum += pos.sum(0)
    return pos_sum + open_[0], below + open_[1], wins + open_[0] * (below + open_[1] / 2)


def auc_values(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """The same of the mean one-against-the-rest AUC, weighted by prevalence, of rows (class, bucket, grp, score, positive, n).

    Rows are dealt to ranges of scores, which sum up wins within themselves, and
    then the ranges of a class are joined, so no task orders all scores.  A range is sent the
    weights of its groups, once for all models and classes; rows go without.
    """
    def part(rows: pa.Table, weights: pa.Table) -> pa.Table:
        schema = pa.schema([("dataset", pa.string()), ("seed", pa.int64()), ("model", pa.string()), ("class", pa.int32()), ("bucket", pa.int32()), ("pos", pa.binary()), ("neg", pa.binary()), ("wins", pa.binary())])
        if not rows.num_rows:
            return schema.empty_table()
        w, group = weights_of(weights), groups_of(rows, weights)
        models = pc.dictionary_encode(rows.column("model").combine_chunks())
        model, kind, score, n, positive = models.indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("class", "score", "n", "positive"))
        order = np.lexsort((score, kind, model))
        edges = np.flatnonzero(np.diff(model[order], prepend=-1) | np.diff(kind[order], prepend=-1))
        out = []
        for one in np.split(order, edges[1:]):
            sums = side_sums(group[one], n[one], score[one], positive[one], w)
            out.append((models.dictionary[int(model[one[0]])].as_py(), int(kind[one[0]]), *(x.tobytes() for x in sums)))
        dataset, seed, bucket = ([rows.column(c)[0].as_py()] * len(out) for c in ("dataset", "seed", "bucket"))
        name, kinds, pos, neg, wins = zip(*out)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((dataset, seed, name, kinds, bucket, pos, neg, wins), schema)], schema=schema)

    def one_class(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("bucket").to_numpy())))
        pos, neg, wins = (np.stack([np.frombuffer(x.as_buffer(), "<f8") for x in rows.column(c)]) for c in ("pos", "neg", "wins"))
        wins = (wins + pos * (np.cumsum(neg, 0) - neg)).sum(0)
        pos, neg = pos.sum(0), neg.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            auc = wins / (pos * neg)
        keys = {c: rows.column(c).slice(0, 1) for c in ("dataset", "seed", "model")}
        return pa.table({**keys, "auc": pa.array([auc.tobytes()], pa.binary()), "pos": pa.array([pos.tobytes()], pa.binary())})

    def whole(rows: pa.Table) -> pa.Table:
        auc, pos = (np.stack([np.frombuffer(x.as_buffer(), "<f8") for x in rows.column(c)]) for c in ("auc", "pos"))
        values = (auc * pos).sum(0) / pos.sum(0)  # NaN where any class has none or all of the rows
        keys = {c: [rows.column(c)[0].as_py()] for c in ("dataset", "seed", "model")}
        return pa.table({**keys, "metric": ["auc"], "values": pa.array([values.tolist()], pa.list_(pa.float64()))})

    keys = "dataset string, seed long, model string"
    by = ["dataset", "seed", "bucket"]
    asked = scores.select(*by, "grp").distinct().join(weights, ["dataset", "seed", "grp"])
    asked = asked.toDF(*asked.columns)  # columns of its own
    parts = scores.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(part, keys + ", class int, bucket int, pos binary, neg binary, wins binary")
    classes = parts.groupBy("dataset", "seed", "model", "class").applyInArrow(one_class, keys + ", auc binary, pos binary")
    return classes.groupBy("dataset", "seed", "model").applyInArrow(whole, keys + ", metric string, values array<double>")


def bootstrap(predictions: DataFrame, replicates: int) -> DataFrame:
    """dataset, seed, b, model, metric, value; b = 0 is the point estimate.  All models share a replicate's draws.

    Predictions are counted by group and cell, and by group and score, before
    weights meet them; a row then has its weights in all replicates.  Undefined
    values are null.
    """
    predictions = with_prediction(effective_groups(predictions))
    predictions = predictions.withColumns({"dataset": F.col("dataset").cast("string"), "seed": F.col("seed").cast("long"), "model": F.col("model").cast("string")})
    weights = draws.resampled(predictions, replicates)
    unit, by = ["dataset", "seed", "model"], ["dataset", "seed", "grp"]
    cells = predictions.groupBy(*unit, "grp", F.col("target").cast("long").alias("target"), F.col("pred").cast("long").alias("pred")).agg(F.count("*").alias("n"))
    scores = predictions.select(*unit, "grp", "target", F.posexplode("probs").alias("class", "score"))
    scores = scores.groupBy(*unit, "grp", "class", "score", (F.col("target") == F.col("class")).alias("positive")).agg(F.count("*").alias("n"))
    rows, some = (t.groupBy("dataset", "seed").agg(n.alias("n")).agg(F.max("n")).first()[0] or 0 for t, n in ((predictions, F.sum(F.size("probs"))), (weights, F.count("*"))))
    held = HELD_ROWS * (HELD_MORE if some <= HELD_ROWS else 1)
    found = confusion_values(cells, weights, max(1, math.ceil(some / HELD_ROWS))).unionByName(auc_values(written(in_ranges(scores, max(1, math.ceil(rows / held))), "scores"), weights))
    found = found.select(*unit, "metric", F.posexplode("values").alias("b", "value"))
    return found.select("dataset", F.col("seed").cast("int").alias("seed"), "b", "model", "metric", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


def over_seeds(values: DataFrame) -> DataFrame:
    """Mean of each replicate over the seeds; an undefined seed makes it undefined."""
    mean = F.when(F.count("value") == F.count("*"), F.avg("value"))
    return values.groupBy("dataset", "b", "model", "metric").agg(mean.alias("value"))


def intervals(values: DataFrame) -> DataFrame:
    """dataset, model, metric, mean, ci_low, ci_high."""
    mean = over_seeds(values)
    point = mean.where("b = 0").select("dataset", "model", "metric", F.col("value").alias("mean"))
    ends = mean.where("b > 0").groupBy("dataset", "model", "metric").agg(F.expr(f"percentile(value, array{LEVELS})").alias("q"))
    return point.join(ends, ["dataset", "model", "metric"]).select("dataset", "model", "metric", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def pairwise(values: DataFrame) -> DataFrame:
    """dataset, metric, model_a, model_b, diff, ci_low, ci_high, p, p_holm for each pair of models."""
    mean = over_seeds(values)
    by = ["dataset", "metric", "model_a", "model_b"]
    pair = mean.alias("x").join(mean.alias("y"), (F.col("x.dataset") == F.col("y.dataset")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.metric") == F.col("y.metric")) & (F.col("x.model") < F.col("y.model")))
    pair = pair.select(F.col("x.dataset"), F.col("x.metric"), F.col("x.model").alias("model_a"), F.col("y.model").alias("model_b"), F.col("x.b").alias("b"), F.round(F.col("x.value") - F.col("y.value"), 9).alias("d"))
    drawn = F.when(F.col("b") > 0, F.col("d"))
    one = pair.groupBy(*by).agg(
        F.max(F.when(F.col("b") == 0, F.col("d"))).alias("diff"),
        F.percentile(drawn, F.array(*map(F.lit, LEVELS))).alias("q"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((drawn <= 0).cast("double")), F.avg((drawn >= 0).cast("double")))).alias("p"),
    )
    return holm(one.select(*by, "diff", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), "p"), ["dataset", "metric"], ["model_a", "model_b"])


def holm(tests: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """Adds p_holm: step-down, never above 1, never falling; an undefined p counts as a test and becomes 1."""
    by = W.partitionBy(*family) if family else W.partitionBy(F.lit(1))
    sorted_ = by.orderBy(F.col("p").asc_nulls_last(), *order)
    factor = F.count("*").over(by) - F.row_number().over(sorted_) + 1
    stepped = tests.withColumn("_step", F.least(F.lit(1.0), factor * F.coalesce("p", F.lit(1.0))))
    return stepped.withColumn("p_holm", F.max("_step").over(sorted_.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def replicate_ranks(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds rank among the models: equal values share the better one, undefined values come last."""
    order = F.coalesce(F.col("value"), F.lit(float("-inf"))).desc()
    return values.withColumn("rank", F.rank().over(W.partitionBy(*(by or ["dataset", "seed", "b", "metric"])).orderBy(order)))


def rank_shares(values: DataFrame) -> DataFrame:
    """dataset, metric, model, rank, share, mean_rank over all seeds and replicates."""
    keys = ["dataset", "metric", "model"]
    ranked = replicate_ranks(values.where("b > 0")).groupBy(*keys, "rank").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return ranked.select(*keys, "rank", (F.col("n") / total).alias("share"), (F.sum(F.col("n") * F.col("rank")).over(W.partitionBy(*keys)) / total).alias("mean_rank"))


def rank_intervals(shares: DataFrame) -> DataFrame:
    """First ranks whose running share reaches 2.5 and 97.5 per cent."""
    keys = ["dataset", "metric", "model"]
    running = shares.withColumn("run", F.sum("share").over(W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    first = lambda q: F.min(F.when(F.col("run") >= q - 1e-12, F.col("rank")))
    return running.groupBy(*keys).agg(F.max("mean_rank").alias("mean_rank"), first(LEVELS[0]).alias("rank_low"), first(LEVELS[1]).alias("rank_high"))


def average_ranks(scores: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank: equal values share the mean of their places."""
    ties = F.count("*").over(W.partitionBy(*by, "value"))
    return scores.withColumn("rank", F.rank().over(W.partitionBy(*by).orderBy(F.desc("value"))) + (ties - 1) / 2).withColumn("ties", ties)


def friedman(scores: DataFrame, models: int | None = None) -> DataFrame:
    """n, k, statistic (corrected for ties), p of the Friedman test over datasets that have every model (``models`` of them); scores: dataset, model, value."""
    models = models or scores.select("model").distinct().count()
    complete = scores.groupBy("dataset").agg(F.countDistinct("model").alias("m")).where(F.col("m") == models).select("dataset")
    ranked = average_ranks(scores.join(complete, "dataset"), ["dataset"])
    sizes = ranked.agg(F.countDistinct("dataset").cast("double").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    sums = ranked.groupBy("model").agg(F.sum("rank").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("squares"), F.count("*").cast("double").alias("k"))
    row = sizes.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one")
    n, k = F.col("n"), F.col("k")
    raw = 12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    correction = 1 - F.col("tied") / (n * (k * k * k - k))
    out = row.where("n >= 2 and k >= 3").select(F.col("n").cast("long"), F.col("k").cast("long"), F.try_divide(raw, correction).alias("statistic"))
    found = [(r["n"], r["k"], r["statistic"], None if r["statistic"] is None else chi2_tail(r["statistic"], r["k"] - 1)) for r in out.collect()]  # one row
    return scores.sparkSession.createDataFrame(found, "n long, k long, statistic double, p double")


def friedman_by_task(scores: DataFrame, ordinal: DataFrame) -> DataFrame:
    """task (categorical, ordinal, all), n, k, statistic, p: the test over the datasets of each kind; those of ``ordinal`` (dataset) have ordered classes."""
    kinds = {"categorical": scores.join(ordinal, "dataset", "left_anti"), "ordinal": scores.join(ordinal, "dataset", "left_semi"), "all": scores}
    # all models count, whatever kind they occur in
    models = scores.select("model").distinct().count()
    out = None
    for task, rows in kinds.items():
        part = friedman(rows, models).select(F.lit(task).alias("task"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def official(values: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Replicates of the smallest seed for datasets whose seeds have the same point estimates, as official partitions do; those of all seeds elsewhere."""
    spread = values.where("b = 0").groupBy("dataset", "model", "metric").agg((F.coalesce(F.max("value") - F.min("value"), F.lit(0.0)) + F.when((F.count("value") > 0) & (F.count("value") < F.count("*")), 1.0).otherwise(0.0)).alias("spread"))
    same = spread.groupBy("dataset").agg((F.max("spread") <= tolerance).alias("same"))
    first = values.groupBy("dataset").agg(F.min("seed").alias("first"))
    return values.join(same.join(first, "dataset"), "dataset").where(~F.col("same") | (F.col("seed") == F.col("first"))).drop("same", "first")


def nemenyi_distance(models: int, datasets: int) -> float | None:
    q = NEMENYI_Q.get(models)
    return None if q is None or not datasets else q * (models * (models + 1) / (6 * datasets)) ** 0.5


def cliques(ranks: DataFrame, distance: float) -> DataFrame:
    """lo, hi of the longest runs of mean ranks (model, mean_rank) no wider than ``distance``, none within another."""
    # a row for each model: few enough for one task
    near = ranks.select(F.col("mean_rank").alias("other"))
    pairs = ranks.join(near, (F.col("other") >= F.col("mean_rank")) & (F.col("other") <= F.col("mean_rank") + distance))
    runs = pairs.groupBy(F.col("mean_rank").alias("lo")).agg(F.max("other").alias("hi")).where("hi > lo")
    before = F.max("hi").over(W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
    return runs.withColumn("before", before).where("before is null or before < hi").select("lo", "hi")


def spearman(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rank correlation of two tables (model, value)."""
    a, b = (average_ranks(t.withColumn("one", F.lit(1)), ["one"]).select("model", F.col("rank").alias(x)) for t, x in ((left, "a"), (right, "b")))
    return a.join(b, "model").agg(F.corr("a", "b").alias("rho"))


def marks(means: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """dataset, model, mark: bold where the best model beats all others, else under for it and those it doesn't beat.

    A missing test counts as no difference; a single model gets no mark.
    """
    by = W.partitionBy("dataset")
    ranked = means.withColumn("place", F.row_number().over(by.orderBy(F.desc("mean"), "model"))).withColumn("models", F.count("*").over(by))
    best = ranked.where("place = 1").select("dataset", F.col("model").alias("best"))
    both = tests.select("dataset", F.col("model_a").alias("best"), F.col("model_b").alias("model"), "p").unionByName(tests.select("dataset", F.col("model_b").alias("best"), F.col("model_a").alias("model"), "p"))
    joined = ranked.join(best, "dataset").join(both, ["dataset", "best", "model"], "left")
    tied = (F.col("model") != F.col("best")) & (F.col("p").isNull() | (F.col("p") >= alpha))
    joined = joined.withColumn("tied", tied).withColumn("n_tied", F.sum(tied.cast("int")).over(by))
    mark = F.when(F.col("models") < 2, "").when((F.col("model") == F.col("best")) & (F.col("n_tied") == 0), "bold").when((F.col("model") == F.col("best")) | F.col("tied"), "under").otherwise("")
    return joined.select("dataset", "model", "mean", mark.alias("mark"), ((F.col("model") != F.col("best")) & F.col("p").isNull()).alias("untested"))
