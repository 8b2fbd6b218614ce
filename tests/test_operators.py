"""Known answers and invariants of the evaluation operators."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from evalweave import catalog, catalog_stores
from evalweave.functions import expressions as X
from evalweave.operators import attention, dedup, draws, geometry, graph, index, inference, lifecycle, meetings, metrics, neighbours, probe, quantiles, raster, report, softmax, splits, tiles, vectors
from evalweave.plans import resume
from evalweave.sources import runs, storage, units
from evalweave.streaming import shards


def test_holm(spark):
    tests = spark.createDataFrame([("a", 0.04), ("b", 0.01), ("c", 0.02), ("d", None)], "pair string, p double").withColumn("f", F.lit(1))
    three = inference.holm(tests.where("p is not null"), ["f"], ["pair"]).collect()
    assert {r.pair: round(r.p_holm, 6) for r in three} == {"a": 0.04, "b": 0.03, "c": 0.04}
    four = {r.pair: r.p_holm for r in inference.holm(tests, ["f"], ["pair"]).collect()}
    assert four["d"] == 1.0 and round(four["b"], 6) == 0.04


def test_tile_axis(spark):
    sides = spark.createDataFrame([(500,), (300,), (672,), (447,), (150,)], "n int")
    got = {r.n: list(r.a) for r in sides.select("n", tiles.axis(F.col("n")).alias("a")).collect()}
    assert got == {500: [26, 250], 300: [38], 672: [0, 224, 448], 447: [111], 150: [-37]}
    assert spark.range(1).select(tiles.resampled(F.lit(1000)), tiles.resampled(F.lit(601)), tiles.resampled(F.lit(1))).first()[:] == (500, 300, 1)


def test_fallback_tile(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.05), (1, 224, 0, 0.05), (2, 0, 0, 0.5), (2, 224, 0, 0.01)], "roi_row int, x int, y int, tissue_frac double")
    got = {(r.roi_row, r.x, r.fallback) for r in tiles.kept_tiles(rows, "roi_row").collect()}
    assert got == {(1, 0, 1), (2, 0, 0)}


def test_pixels_are_made_once(spark):
    plan = catalog.QUERIES["pixel_fractions"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_pixels(spark):
    known = [((180, 80, 160), True), ((255, 255, 255), False), ((0, 0, 0), False), ((200, 200, 190), False), ((40, 20, 30), True), ((30, 10, 20), False)]
    rows = spark.createDataFrame([(*rgb, t) for rgb, t in known], "r int, g int, b int, t boolean")
    assert rows.where(X.is_tissue(F.col("r"), F.col("g"), F.col("b")) != F.col("t")).count() == 0


def sample_predictions(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        target, group = (i // 10) % 2, str(i // 10)
        good = 0.9 if target else 0.1
        noise = float(rng.random())
        for model, p in (("good", good), ("good_copy", good), ("noise", noise)):
            rows.append((model, "clus", 42, i, group, target, [1 - p, p]))
            rows.append((model, "flat", 42, i, "", target, [1 - p, p]))
    return spark.createDataFrame(rows, "model string, dataset string, seed int, row_id long, grp string, target int, probs array<double>")


def test_bootstrap(spark):
    values = storage.written(inference.bootstrap(sample_predictions(spark), 60), "values")
    tests = {(r.dataset, r.metric, r.model_a, r.model_b): r for r in inference.pairwise(values).collect()}
    same = tests["clus", "acc", "good", "good_copy"]
    assert same["diff"] == 0 and same.p == 1 and same.p_holm == 1
    assert tests["clus", "acc", "good", "noise"].p_holm < 0.05
    assert tests["clus", "auc", "good", "noise"].p_holm < 0.05
    ranks = {(r.dataset, r.model, r["rank"]): r.share for r in inference.rank_shares(values.where("metric = 'acc'")).collect()}
    assert ranks["clus", "good", 1] == 1 and ranks["clus", "good_copy", 1] == 1 and ranks["clus", "noise", 3] == 1


def test_clusters_widen_intervals(spark):
    rows = [("m", d, 42, i, g, 1 if i % 2 else 0, [0.2, 0.8] if (i // 20) % 2 == i % 2 else [0.8, 0.2]) for i in range(400) for d, g in (("clus", str(i // 20)), ("flat", ""))]
    rows = [(m, d, s, i, g, (i // 20 + j) % 2, [0.2, 0.8] if (i // 20) % 3 else [0.8, 0.2]) for j, (m, d, s, i, g, _, _) in enumerate(rows)]
    preds = spark.createDataFrame(rows, "model string, dataset string, seed int, row_id long, grp string, target int, probs array<double>")
    preds = preds.withColumn("target", F.when(F.floor(F.col("row_id") / 20) % 2 == 0, 1).otherwise(0))
    ci = {r.dataset: r.ci_high - r.ci_low for r in inference.intervals(inference.bootstrap(preds, 100)).where("metric = 'acc'").collect()}
    assert ci["clus"] > 2 * ci["flat"]


def test_auc_and_qwk(spark):
    rng = np.random.default_rng(1)
    score, target, w = np.round(rng.random(60), 1), rng.integers(0, 2, 60), rng.integers(1, 4, 60).astype(float)
    rows = spark.createDataFrame([(1, float(s), bool(t), float(x)) for s, t, x in zip(score, target, w)], "k int, score double, positive boolean, w double")
    brute = sum(a * b * ((s > r) + 0.5 * (s == r)) for s, t, a in zip(score, target, w) if t for r, u, b in zip(score, target, w) if not u) / (w[target == 1].sum() * w[target == 0].sum())
    assert math.isclose(metrics.auc(rows, ["k"]).first()["auc"], brute)
    one = rows.where("positive")
    assert metrics.auc(one, ["k"]).first()["auc"] is None
    table = spark.createDataFrame([(1, 0, 0, 3.0), (1, 1, 3, 1.0), (1, 3, 3, 2.0), (1, 3, 1, 1.0)], "k int, target int, pred int, w double")
    got = metrics.from_confusion(table, ["k"]).first()
    o = np.array([[3, 0, 0], [0, 0, 1], [0, 1, 2]], float)  # positions of labels 0, 1, 3
    d = np.subtract.outer(np.arange(3), np.arange(3)) ** 2
    assert math.isclose(got.qwk, 1 - (d * o).sum() / (d * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum())
    assert math.isclose(got.acc, 5 / 7)


def test_marks(spark):
    means = spark.createDataFrame([("d", "a", 0.9), ("d", "b", 0.8), ("d", "c", 0.7)], "dataset string, model string, mean double")
    tests = lambda ab: spark.createDataFrame([("d", "a", "b", ab), ("d", "a", "c", 0.001)], "dataset string, model_a string, model_b string, p double")
    assert {r.model: r.mark for r in inference.marks(means, tests(0.01)).collect()} == {"a": "bold", "b": "", "c": ""}
    assert {r.model: r.mark for r in inference.marks(means, tests(0.2)).collect()} == {"a": "under", "b": "under", "c": ""}
    assert {r.model: r.mark for r in inference.marks(means, tests(0.2).where("model_b = 'b'")).collect()}["c"] == "under"
    assert inference.marks(means.where("model = 'a'"), tests(0.2)).first().mark == ""


def test_splits(spark):
    items = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 20).cast("string").alias("grp"), (F.col("id") % 3).alias("label"))
    s = splits.split_rows(items, 42)
    assert s.count() == 400 and splits.leaks(s).count() == 0
    assert {r.part: r.n for r in s.groupBy("part").agg(F.countDistinct("grp").alias("n")).collect()} == {"test": 4, "val": 4, "train": 12}
    flat = splits.split_rows(items.withColumn("grp", F.lit("")), 42)
    assert flat.count() == 400 and 70 <= flat.where("part = 'test'").count() <= 90
    with pytest.raises(ValueError):
        splits.split_rows(items.withColumn("part", F.lit("train")), 42, official=True)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)] + [(200, x) for x in range(201, 260)]
    got = {r.u: r.label for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[102] == 100 and {got[x] for x in range(200, 260)} == {200}
    assert graph.components(spark.createDataFrame([(5, 5)], "u long, v long")).count() == 0


def test_votes_are_linear(spark):
    feats = spark.range(300).select(F.col("id").alias("owner"), F.lit("common").alias("feature"))
    assert dedup.votes(feats, least=1).count() == 299


def test_votes_count_every_shared_feature(spark):
    rng = np.random.default_rng(4)
    sets = {i: set(rng.choice(60, int(rng.integers(1, 25)), replace=False).tolist()) | {1000} for i in range(60)}
    sets |= {100 + i: sets[i] for i in range(5)}
    feats = spark.createDataFrame([(o, f"f{x}") for o, xs in sets.items() for x in xs], "owner long, feature string")
    first = {frozenset(xs): min(o for o in sets if sets[o] == xs) for xs in sets.values()}
    heads = sorted(set(first.values()))
    want = {(a, b): len(sets[a] & sets[b]) for i, a in enumerate(heads) for b in heads[i + 1 :] if len(sets[a] & sets[b]) >= 6}
    want |= {(first[frozenset(xs)], o): len(xs) for o, xs in sets.items() if first[frozenset(xs)] != o and len(xs) >= 6}
    found = dedup.votes(feats)
    assert {(r.a, r.b): r.votes for r in found.collect()} == want
    kept = {(r.a, r.b) for r in dedup.verified(found, feats, 8, 0.6).collect()}
    assert kept == {(a, b) for (a, b), n in want.items() if n >= 8 and n / min(len(sets[a]), len(sets[b])) >= 0.6}
    assert {(r.a, r.b): r.votes for r in dedup.shared(found, feats).collect()} == want


@pytest.mark.parametrize("held", [5000, 40])
def test_replicates_as_brute_force(spark, monkeypatch, held):
    """Every metric of every replicate, from rows repeated as often as they were drawn."""
    monkeypatch.setattr(inference, "HELD_ROWS", held)
    rng = np.random.default_rng(2)
    n, classes = 150, 3
    rows = []
    for i in range(n):
        target = int(rng.integers(0, classes))
        for model in ("a", "b"):
            p = np.round(rng.dirichlet(np.ones(classes)), 1)  # ties
            rows.append((model, "d", 42, i, str(i % 12), target, p.tolist()))
    preds = spark.createDataFrame(rows, "model string, dataset string, seed int, row_id long, grp string, target int, probs array<double>")
    values = {(r.model, r.b, r.metric): r.value for r in inference.bootstrap(preds, 5).collect()}
    weights = {(r.b, r.grp): r.w for r in inference.resamples(preds, 5).collect()}
    for model in ("a", "b"):
        own = [x for x in rows if x[0] == model]
        for b in range(6):
            w = np.array([1.0 if b == 0 else weights.get((b, x[4]), 0.0) for x in own])
            target, probs = np.array([x[5] for x in own]), np.array([x[6] for x in own])
            pred = probs.argmax(1)
            counts = np.zeros((classes, classes))
            np.add.at(counts, (target, pred), w)
            row, col, hit = counts.sum(1), counts.sum(0), np.diag(counts)
            apart = np.subtract.outer(np.arange(classes), np.arange(classes)) ** 2
            auc = []
            for c in range(classes):
                s, pos = probs[:, c], target == c
                wins = sum(x * y * ((a > e) + 0.5 * (a == e)) for a, x in zip(s[pos], w[pos]) for e, y in zip(s[~pos], w[~pos]))
                auc.append(wins / (w[pos].sum() * w[~pos].sum()))
            want = {"acc": hit.sum() / w.sum(), "bal_acc": (hit / row).mean(), "f1_weighted": (2 * hit / (row + col) * row).sum() / w.sum(), "qwk": 1 - (apart * counts).sum() * w.sum() / (apart * np.outer(row, col)).sum(), "auc": (np.array(auc) * row).sum() / row.sum()}
            for metric, x in want.items():
                assert math.isclose(values[model, b, metric], x, rel_tol=1e-9), (model, b, metric)


def test_weights_are_sent_once(spark, monkeypatch):
    """A range of scores gets the weights of its groups, not of its rows, and weighs few rows at a time; equal scores are carried on."""
    monkeypatch.setattr(inference, "WEIGHED_ROWS", 7)
    rng = np.random.default_rng(5)
    n, w = rng.integers(1, 4, 200), rng.integers(0, 5, (12, 6))
    score, positive, group = np.sort(rng.integers(0, 20, 200) / 20), rng.random(200) < 0.4, rng.integers(0, 12, 200)
    x = w[group] * n[:, None]
    ahead = (score[:, None] > score) + 0.5 * (score[:, None] == score)
    want = [x[positive].sum(0), x[~positive].sum(0), np.einsum("ir,jr,ij->r", x[positive], x[~positive], ahead[positive][:, ~positive])]
    assert all(np.allclose(a, b) for a, b in zip(inference.side_sums(group, n, score, positive, w), want))
    scores = spark.createDataFrame([("d", 1, "m", i % 3, 0, str(i % 2), i / 100, i % 5 == 0, 1) for i in range(100)], "dataset string, seed long, model string, class int, bucket int, grp string, score double, positive boolean, n long")
    weights = spark.createDataFrame([("d", 1, g, np.ones(1000, "<u4").tobytes()) for g in "01"], "dataset string, seed long, grp string, weights binary")
    assert inference.auc_values(scores, weights).count() == 1


def test_split_is_binomial():
    """Against exact binomial distributions, at both ends and for large numbers."""
    for n, left, whole in ((1, 1, 2), (7, 1, 3), (60, 59, 60), (40, 1, 1000)):
        low, known = draws.distribution(n, left, whole)
        p = left / whole
        want = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert np.allclose(known, want[low : low + len(known)], atol=1e-13) and (low == 0 or want[low - 1] < 1e-30)
        u = np.array([1e-20, 1e-12, 0.3, 0.999999, 1 - 1e-16])
        assert draws.split(np.full(5, n), left, whole, u).tolist() == [min(n, int((want < x).sum())) for x in u]
    low, known = draws.distribution(10**6, 1, 2)
    assert low > 0 and len(known) < 20_000 and math.isclose(known[-1], 1, abs_tol=1e-9) and abs(low + np.searchsorted(known, 0.5) - 500_000) < 5


def test_draws_are_multinomial(spark, monkeypatch):
    """Sums are the numbers of groups; counts pass chi-square tests over groups, pairs and replicates; the tree doesn't depend on its tiers."""
    groups = spark.createDataFrame([(d, s, f"g{i}") for d, s, n in (("a", 1, 600), ("a", 2, 40), ("b", 1, 1)) for i in range(n)], "dataset string, seed long, grp string")
    attempts = {("a", 1): np.zeros(200, np.int64), ("a", 2): np.zeros(200, np.int64), ("b", 1): np.zeros(200, np.int64)}
    found = {}
    for leaves in (512, 4):
        monkeypatch.setattr(draws, "LEAVES", leaves)
        rows = draws.drawn(groups, attempts).collect()
        found[leaves] = {(r.dataset, r.seed, r.grp): np.frombuffer(r.weights, "<u4").astype(float) for r in rows}
    assert found[512].keys() == found[4].keys() and all((found[512][k] == w).all() for k, w in found[4].items())
    for (d, s), n in ((("a", 1), 600), (("a", 2), 40), (("b", 1), 1)):
        w = np.stack([x for k, x in found[512].items() if k[:2] == (d, s)])
        assert len(w) == n and (w.sum(0) == n).all()
        if n > 1:
            # a group's draws over all replicates: n * 200 draws over n groups
            total = w.sum(1)
            assert abs(((total - 200) ** 2 / 200).sum() - (n - 1)) < 5 * math.sqrt(2 * (n - 1))
            # each replicate's own statistic has the mean n - 1 and the variance 2 (n - 1) (1 - 1 / n)
            each = ((w - 1) ** 2).sum(0)
            assert abs(each.mean() - (n - 1)) < 5 * math.sqrt(2 * (n - 1) / 200) and 0.6 < each.var() / (2 * (n - 1)) < 1.6
            # negative correlation of any two groups: -1 / n
            assert abs(np.cov(w).sum() - np.trace(np.cov(w)) + (n - 1)) < 0.2 * n


def test_draws_without_a_class_are_repeated(spark):
    preds = spark.createDataFrame([("d", 1, str(i), 1 if i == 0 else 0) for i in range(6)], "dataset string, seed long, grp string, target int")
    rows = draws.resampled(preds, 50).collect()
    w = {r.grp: np.frombuffer(r.weights, "<u4") for r in rows}
    assert (w["0"] > 0).all() and (sum(w[str(i)].astype(int) for i in range(1, 6)) > 0).all() and (sum(x.astype(int) for x in w.values()) == 6).all()


def test_ungrouped_rows_draw_themselves(spark):
    """20,000 rows as groups: one row each, whatever the replicates."""
    preds = spark.range(20_000).select(F.lit("d").alias("dataset"), F.lit(1).alias("seed"), F.col("id").cast("string").alias("grp"), (F.col("id") % 2).cast("int").alias("target"))
    rows = draws.resampled(preds, 20).collect()
    w = np.stack([np.frombuffer(r.weights, "<u4") for r in rows]).astype(float)
    assert w.shape == (20_000, 20) and (w.sum(0) == 20_000).all()
    # shares of rows that are drawn 0, 1 and 2 times are those of a Poisson variable
    for k, p in ((0, math.exp(-1)), (1, math.exp(-1)), (2, math.exp(-1) / 2)):
        assert abs((w == k).mean() - p) < 0.005


def test_ranks_by_hash(spark):
    items = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("label"))
    rows = splits.ranked(items, X.hash_text(1, F.col("row_id")), "row_id", "label").collect()
    import hashlib

    for label in {r.label for r in rows}:
        own = sorted((hashlib.md5(f"1:{r.row_id}".encode()).hexdigest(), r.row_id, r["rank"], r.n) for r in rows if r.label == label)
        assert [x[2] for x in own] == list(range(1, len(own) + 1)) and {x[3] for x in own} == {len(own)}
    assert len(rows) == 500


def test_floating_point_kinds(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=300), rng.normal(size=100) * 1e-6, [0.0, -0.0, 1.0, 65504.0, 70000.0, -70000.0, 2.0**-24, 1.5 * 2.0**-25]]).astype(np.float32)
    rows = spark.createDataFrame([(x.astype(float).tolist(),)], "v array<double>")
    half = rows.select(X.floating(F.col("v"), 11, -14, 65504.0).alias("v")).first().v
    assert half == x.astype(np.float16).astype(float).tolist()
    bits = x.view(np.uint32)
    brain = ((bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    assert rows.select(X.floating(F.col("v"), 8, -126, 3.3895313892515355e38).alias("v")).first().v == brain.astype(float).tolist()


def probe_rows(spark, n=240):
    rng = np.random.default_rng(9)
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 6)) + 1.5 * np.eye(3, 6)[label]
    part = np.where(np.arange(n) % 5 == 0, "test", np.where(np.arange(n) % 5 == 1, "val", "train"))
    return spark.createDataFrame([("m", i, x[i].tolist(), int(label[i]), str(part[i])) for i in range(n)], "model string, row_id long, v array<double>, label int, part string"), x, label, part


def test_probe_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 4, 200)
    w = probe.solve(x, y, 4, 0.5)
    slope = np.concatenate([x, np.ones((200, 1))], 1).T @ (probe.probabilities(x, w) - np.eye(4)[y])
    slope[:-1] += w[:-1] / 0.5
    assert np.abs(slope).max() < 1e-4


def test_probe_life(spark):
    items, x, label, part = probe_rows(spark)
    found = storage.written(lifecycle.run_units(items, ["model"]), "units")
    chosen = found.first().c_value
    values = []
    for c in sorted(probe.C_GRID):
        fit, val = part == "train", part == "val"
        mean, sd = probe.moments_of(x[fit])
        p = probe.probabilities((x[val] - mean) / sd, probe.solve((x[fit] - mean) / sd, label[fit], 3, c))
        auc = [np.mean([(a > e) + 0.5 * (a == e) for a in p[label[val] == k, k] for e in p[label[val] != k, k]]) for k in range(3)]
        values.append((-np.average(auc, weights=np.bincount(label[val])), c))
    assert chosen == min(values)[1] and found.count() == (part == "test").sum()
    fit, test = part != "test", part == "test"
    mean, sd = probe.moments_of(x[fit])
    p = probe.probabilities((x[test] - mean) / sd, probe.solve((x[fit] - mean) / sd, label[fit], 3, chosen))
    got = {r.row_id: r.probs for r in found.collect()}
    assert all(np.allclose(got[i], q, atol=1e-9) for i, q in zip(np.flatnonzero(test).tolist(), p))
    stored = storage.written(metrics.auc_one_vs_rest(found, ["model", "c_value"]), "stored")
    external = items.select((F.col("row_id") + 1000).alias("row_id"), "v", "label").limit(50)
    out = lifecycle.outside(items, external, stored, ["model"])
    assert out.count() == 50 and out.agg(F.min("row_id")).first()[0] >= 1000
    with pytest.raises(Exception, match="isn't the stored probe"):
        lifecycle.outside(items, external, stored.withColumn("auc", F.col("auc") - 1e-3), ["model"]).collect()
    kinds = {"fp32": lambda v: v, "int4": lambda v: X.quantised(v, 4)}
    rounded_ = lifecycle.precisions(items, stored, ["model"], kinds)
    same = {r.row_id: r.probs for r in rounded_.where("kind = 'fp32'").collect()}
    assert rounded_.count() == 2 * test.sum() and all(np.allclose(same[i], got[i]) for i in got)


@pytest.mark.parametrize("few", [0, 16])
def test_passes_as_one_matrix(spark, monkeypatch, few):
    """Units of other widths and classes, all in the same passes over 7 partitions, against the plain solver; every batch is cut."""
    monkeypatch.setattr(softmax, "FEW", few)
    rng = np.random.default_rng(5)
    rows, data = [], {}
    for unit, (n, d, k) in enumerate([(150, 4, 3), (90, 2, 2), (60, 6, 4)]):
        y = rng.integers(0, k, n)
        x = rng.normal(size=(n, d)) * [10.0 ** (j % 3) for j in range(d)] + np.eye(k, d)[y] + 100
        data[f"u{unit}", unit] = (x, y, k)
        rows += [(f"u{unit}", unit, x[i].tolist(), int(y[i])) for i in range(n)]
    rows += [("u0", 0, None, 1), ("u0", 0, [0.0] * 4, None), (None, 1, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, "model string, seed int, v array<double>, label int").repartition(7)
    grid = {u: [0.01, 1.0, 100.0][: i + 1] for i, u in enumerate(data)}
    found = softmax.fit(df, ["model", "seed"], grid)
    assert set(found) == set(data)
    for u, (x, y, k) in data.items():
        mean, sd = probe.moments_of(x)
        assert np.allclose(found[u].mean, mean) and np.allclose(found[u].sd, sd) and list(found[u].weights) == grid[u]
        for c, w in found[u].weights.items():
            want = probe.probabilities((x - mean) / sd, probe.solve((x - mean) / sd, y, k, c))
            assert np.allclose(softmax.probabilities((x - mean) / sd, w), want, atol=1e-6)
            assert 1 < found[u].passes[c] < 200


def test_two_classes_share_one_logit():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 2, 80)
    w = probe.solve(x, y, 2, 0.3)
    u = w[:, 1] - w[:, 0]
    p = 1 / (1 + np.exp(-(x @ u[:-1] + u[-1])))
    assert np.abs(x.T @ (p - y) + u[:-1] / 0.3).max() < 1e-4 and abs((p - y).sum()) < 1e-4


def test_once_sees_changed_inputs(spark, tmp_path):
    def make():
        return spark.read.parquet(f"{tmp_path}/embeddings.parquet").agg(F.count("*").alias("n"))

    spark.range(10).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert storage.once(spark, str(tmp_path), "rows", make).first().n == 10
    before = len(storage._ONCE)
    assert storage.once(spark, str(tmp_path), "rows", make).first().n == 10 and len(storage._ONCE) == before
    spark.range(20).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert storage.once(spark, str(tmp_path), "rows", make).first().n == 20


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(20)], "row_id long, label int, v array<double>")
    labels = rows.select("row_id", "label")
    mark = index.content_hash(labels, "row_id", F.col("label")).first()["content_hash"]
    runs.write_features(rows.select("row_id", "v"), str(tmp_path / "f"), mark)
    assert runs.load_features(spark, str(tmp_path / "f"), labels).count() == 20
    with pytest.raises(ValueError, match="another index"):
        runs.load_features(spark, str(tmp_path / "f"), labels.withColumn("label", F.col("label") + 1))
    for right in (labels.where("row_id > 0"), labels.union(labels.limit(1)), labels.union(spark.createDataFrame([(99, 1)], labels.schema))):
        with pytest.raises(Exception, match="exactly one partner"):
            runs.one_to_one(labels, right.select("row_id", F.lit(1).alias("z")), "row_id").collect()
    found, note = runs.scan_or_skip(spark, str(tmp_path / "none"), "a int")
    assert found.count() == 0 and note.startswith("skipped")
    assert storage.digests(spark, str(tmp_path / "f" / "done")).where("length(sha256) = 64").count() >= 1


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([("b", "", 2), ("a", "00123", 1)], "path string, grp string, label int")
    storage.write_index(rows, str(tmp_path / "i"))
    back = storage.read_index(spark, str(tmp_path / "i"), "path string, grp string, label int")
    assert [tuple(r) for r in back.orderBy("path").collect()] == [("a", "00123", 1), ("b", "", 2)]
    with pytest.raises(ValueError):
        storage.write_index(rows.union(rows), str(tmp_path / "j"))
    with pytest.raises(Exception, match="no n for"):
        index.strict_lookup(rows, spark.createDataFrame([("a", 1)], "path string, n int"), "path", "n").collect()
    base = spark.range(3000).select("id")
    first = index.content_hash(base, "id", F.col("id")).first().content_hash
    assert first == index.content_hash(base.repartition(7), "id", F.col("id")).first().content_hash
    assert first != index.content_hash(base, "id", F.when(F.col("id") == 2999, 0).otherwise(F.col("id"))).first().content_hash


def test_shards_refuse_bad_vectors(spark, tmp_path):
    good = spark.createDataFrame([(0, [1.0, 2.0])], "row_id long, v array<double>")
    storage.write_shards(good, str(tmp_path / "good"))
    with pytest.raises(Exception):
        storage.write_shards(spark.createDataFrame([(0, [float("nan")])], "row_id long, v array<double>"), str(tmp_path / "bad"))


def test_pooling(spark):
    children = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k long, v array<double>")
    got = {r.k: list(r.v) for r in vectors.pool_mean(children, ["k"], "v").collect()}
    assert got == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    with pytest.raises(Exception, match="no children"):
        vectors.pool_children(spark.createDataFrame([(1,), (3,)], "k long"), children, "k", "v").collect()


def test_nearest_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(70, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in vectors.nearest(rows, 3, block_rows=16).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert all([o for _, o in sorted(got[i])] == np.argsort(-s[i])[:3].tolist() for i in range(70))


def brute_neighbours(x, owner, k, orders=None):
    out = []
    for i in range(len(x)):
        s = np.max([x[i] @ (x if o is None else x[:, o]).T for o in orders or [None]], 0)
        s = np.where(np.asarray(owner) == owner[i], -np.inf, np.round(s, 9))
        best = sorted(range(len(x)), key=lambda j: (-s[j], j))[:k]
        out += [(i, r + 1, j) for r, j in enumerate(best) if s[j] > -np.inf]
    return out


@pytest.mark.parametrize("shape", ["clusters", "sphere", "lengths", "equal"])
def test_neighbours_as_brute_force(spark, shape):
    """Same rows as all against all, over many small blocks; clustered vectors leave most blocks out."""
    rng = np.random.default_rng(7)
    n, d = 600, 8
    x = rng.normal(size=(n, d))
    if shape == "clusters":
        x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] * 4 + 0.05 * x
    if shape != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if shape == "equal":
        x[:400] = x[0]
        x[500] = 0
    owner = rng.integers(0, 250, n).tolist()
    rows = spark.createDataFrame([(i, owner[i], v.tolist()) for i, v in enumerate(x)], "id long, o long, v array<double>")
    for orders in (None, [list(range(d)), list(range(d))[::-1]]):
        got = neighbours.search(rows, 3, 40, "o", orders, cell_rows=8)
        # equal up to products that differ in their last digits by the order of summing
        value = lambda i, j: round(max(float(x[i] @ (x[j] if o is None else x[j][o])) for o in orders or [None]), 7)
        found = sorted((r.id, r["rank"], r.other) for r in got.rows.collect())
        want = brute_neighbours(x, owner, 3, orders)
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert all(f == w or value(*f[::2]) == value(*w[::2]) for f, w in zip(found, want))
        assert got.visited <= got.pairs and (shape != "clusters" or got.visited < got.pairs / 2)


def test_vectors_add_candidates(spark):
    """Three documents of one group: votes keep one candidate each, so only the vectors join the third; a near vector of other sentences is refused."""
    common = [f"s{i}." for i in range(16)]
    texts = {1: [*common, "a1", "a2"], 2: [*common, "a1", "a2"], 3: [*common, "a1", "b3"], 4: [f"t{i}" for i in range(20)]}
    found = spark.createDataFrame([(o, f) for o, fs in texts.items() for f in fs], "owner long, feature string")
    near = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.9, 0.11])], "id long, v array<double>")
    far = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(5)]) for i in range(1, 5)], "id long, v array<double>")
    roots = lambda v, most: {r.owner: (r.root, r.grp) for r in dedup.pipeline(found, v, "x", most=most, near=1).collect()}
    assert roots(near, 0) == {1: (1, "x_src0000"), 3: (1, "x_src0000")}
    assert roots(far, 30) == {o: (1, "x_src0000") for o in (1, 2, 3)}


def test_votes_read_texts_once(spark):
    """Features go as hashes of 16 bytes; none of the texts is in the plan of the votes."""
    found = spark.createDataFrame([(o, f"s{i}." * 50) for o in (1, 2) for i in range(8)], "owner long, feature string")
    rows = dedup.hashed(found)
    assert rows.count() == 16 and {len(r.feature) for r in rows.collect()} == {16}
    got = dedup.votes(found)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 8)] and "md5" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few, most_sets, cells", [(24, 2048, 1 << 20), (3, 9, 60), (2, 1 << 20, 1 << 20)])
def test_votes_are_counted_where_pairs_meet(spark, monkeypatch, few, most_sets, cells):
    """One by one, as matrices and in tiles, what brute force gives; no pair is sent anywhere; the best pairs of each end stay when others are left out early."""
    monkeypatch.setattr(meetings, "FEW", few)
    monkeypatch.setattr(meetings, "MOST_SETS", most_sets)
    monkeypatch.setattr(meetings, "CELLS", cells)
    rng = np.random.default_rng(8)
    owned = {o: {f"{o // 40}.{x}" for x in rng.choice(30, int(rng.integers(4, 20)), replace=False)} | {f"c{x}" for x in rng.choice(9, 3, replace=False)} for o in range(160)}
    owned |= {500 + i: owned[i] for i in range(6)}
    rows = [(o, sorted(xs)) for o, xs in owned.items()]
    rows += [(o, xs[:4]) for o, xs in rows[:20]] + [(None, ["x"] * 9), (900, None), (901, [])]
    found = spark.createDataFrame(rows, "owner long, features array<string>")
    first = {frozenset(xs): min(o for o in owned if owned[o] == xs) for xs in owned.values()}
    heads = sorted(set(first.values()))
    want = {(a, b): len(owned[a] & owned[b]) for i, a in enumerate(heads) for b in heads[i + 1 :] if len(owned[a] & owned[b]) >= 6}
    want |= {(first[frozenset(xs)], o): len(xs) for o, xs in owned.items() if first[frozenset(xs)] != o and len(xs) >= 6}
    got = dedup.votes(found)
    listed = got.collect()
    assert {(r.a, r.b): r.votes for r in listed} == want and len(listed) == len(want)
    assert "hashpartitioning(a" not in got._jdf.queryExecution().executedPlan().toString()
    for most in (1, 3):
        fewer = dedup.votes(found, most=most)
        assert {tuple(r) for r in dedup.candidates(fewer, most=most).collect()} == {tuple(r) for r in dedup.candidates(got, most=most).collect()}
        assert fewer.count() <= len(want)
    near = {(r.a, r.b): r.votes for r in dedup.shared(spark.createDataFrame([(0, 1), (0, 500), (0, 159)], "a long, b long"), found).collect()}
    assert near == {(a, b): len(owned[a] & owned[b]) for a, b in ((0, 1), (0, 500), (0, 159))}


def test_group_numbers_follow_roots(spark):
    groups = spark.createDataFrame([(i, (i // 3) * 7) for i in range(100)], "owner long, root long")
    got = {r.owner: r.grp for r in dedup.named(groups, "g").collect()}
    assert got == {i: f"g_src{i // 3:04d}" for i in range(100)}


def test_blocks_grow_with_rows(spark, monkeypatch):
    """So that a row is sent to few others, whatever their number; products are looked at in doubles only where single ones may reach the k-th."""
    monkeypatch.setattr(neighbours, "LEAST_BLOCK_ROWS", 10)
    looked = []
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:800])], "id long, v array<double>")
    assert neighbours.search(rows, 2, cell_rows=8).pairs <= 40 * 39
    plain = neighbours.paired
    monkeypatch.setattr(neighbours, "paired", lambda a, b, o: looked.append(len(a)) or plain(a, b, o))
    import pyarrow as pa

    t = pa.table({"id": np.arange(4000), "owner": np.arange(4000), "v": pa.array(x.tolist()), "cell": np.zeros(4000, np.int32)})
    row, found, _ = neighbours.compare(t, t, 3, None, x[:1], np.array([np.linalg.norm(x - x[0], axis=1).max()]), None)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert found.tolist() == np.argsort(-s, 1)[:, :3].ravel().tolist() and row.tolist() == np.repeat(np.arange(4000), 3).tolist()
    assert sum(looked) < 4000 * 4000 / 100


def test_equal_vectors_meet_others_once(spark):
    """Of 300 equal vectors three are compared; all of them get what brute force gives, as do zero vectors."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(340, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(340)[:300]] = x[0]
    x[-6:] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = neighbours.search(rows, 2, 20)
    assert sorted((r.id, r["rank"], r.other) for r in got.rows.collect()) == brute_neighbours(x, list(range(340)), 2)
    assert got.pairs <= 30


def test_close_unit_vectors_leave_blocks_out(spark):
    """Directions 0.05 apart with rows 0.002 around them: products differ by less than radii do, distances tell them apart."""
    rng = np.random.default_rng(12)
    centres = np.eye(12)[:8] * 0.05 / np.sqrt(2) + np.ones(12)
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 40, 0) + rng.normal(size=(320, 12)) * 0.0001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = neighbours.search(rows, 2, 40, cell_rows=4)
    assert sorted((r.id, r["rank"], r.other) for r in got.rows.collect()) == brute_neighbours(x, list(range(320)), 2)
    assert got.pairs > 0 and got.visited < got.pairs / 2


def test_pipeline_cuts_texts_once(spark):
    cuts = spark.sparkContext.accumulator(0)

    def cut(i):
        cuts.add(1)
        return f"s{i}."

    found = spark.range(80).select((F.col("id") % 4).alias("owner"), F.udf(cut, "string")(F.floor(F.col("id") / 4)).alias("feature"))
    near = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, v array<double>")
    assert {r.root for r in dedup.pipeline(found, near, "x").collect()} == {0} and cuts.value == 80


def test_letters_are_counted_in_one_pass(spark, tmp_path):
    texts = {1: "tea\u00e9\U0001d552 eel", 2: "", 3: None, 4: "xyz", 5: "E" * 9 + "u", 6: "tt\nhh" * 400}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog_stores.letter_vectors(spark, str(tmp_path))
    got = {r.id: r.v for r in rows.collect()}
    assert got.keys() == texts.keys() - {3} and got[2] == [0.0] * 12
    for i in (1, 4, 5, 6):
        n = [texts[i].count(x) for x in "etaoinshrdlu"]
        assert got[i] == [x / (math.sqrt(sum(x * x for x in n)) + 1e-6) for x in n]
    assert "replace(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_of_few(spark):
    rows = spark.createDataFrame([(1, [1.0]), (None, [2.0]), (2, None)], "id long, v array<double>")
    assert neighbours.search(rows, 2).rows.count() == 0 and neighbours.search(rows.limit(0), 2).rows.count() == 0


@pytest.mark.parametrize("bins,held", [(4, 3), (1024, 4096)])
def test_quantiles_as_numpy(spark, monkeypatch, bins, held):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "HELD", held)
    rng = np.random.default_rng(10)
    data = {"skewed": np.exp(rng.normal(size=300) * 3), "equal": np.full(50, 2.5), "steps": rng.integers(0, 4, 200).astype(float), "one": np.array([-7.0]), None: rng.normal(size=30), "wide": np.concatenate((rng.normal(size=100), [1e300, -1e300]))}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("empty", None), ("empty", float("nan")), ("one", None)]
    shares = (0.0, 0.025, 0.5, 0.9, 1.0)
    got = {r.k: (r.n, r["values"]) for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        assert got[k][0] == len(xs) and np.allclose(got[k][1], np.quantile(xs, shares), rtol=1e-12), k


def test_geometry_finds_planted_transforms(spark):
    """Half of the matches are noise; false pairs have nothing but noise; a pair of one place has no transform."""
    rng = np.random.default_rng(11)
    rows, planted = [], {}
    for pair in range(24):
        p, q = rng.uniform(0, 384, (2, 80, 2)) @ [1, 1j]
        if pair % 2:
            s, t = rng.uniform(0.5, 2) * np.exp(1j * rng.uniform(-3, 3)), complex(*rng.uniform(-90, 90, 2))
            q[:40] = s * p[:40] + t + rng.normal(size=40) * 0.2
            planted[pair] = (s, t)
        order = rng.permutation(80)
        rows += [(pair, pair + 100, k, *(float(c) for c in (p[i].real, p[i].imag, q[i].real, q[i].imag))) for k, i in enumerate(order.tolist())]
    rows += [(50, 51, k, 1.0, 1.0, float(k), 2.0) for k in range(30)] + [(60, 61, 0, 1.0, 2.0, 3.0, 4.0), (60, 61, 1, None, 2.0, 3.0, 4.0)]
    got = {r.a: r for r in geometry.verified(spark.createDataFrame(rows, "a long, b long, k int, x double, y double, u double, v double")).collect()}
    assert {a for a, r in got.items() if r.kept} == set(planted)
    for a, (s, t) in planted.items():
        r = got[a]
        assert r.inliers >= 38 and abs(r.scale * np.exp(1j * r.turn) - s) < 0.05 and abs(complex(r.dx, r.dy) - t) < 10
    assert got[60].matches == 1 and (got[60].inliers, got[50].inliers) == (0, 0) and got[50].scale is None


def test_raster_as_plain_counting(spark):
    """Random regions, some smaller than a tile and with blocks that hold nothing; tiles at and over all borders."""
    rng = np.random.default_rng(12)
    pixels, tile_rows, want = [], [], {}
    for key, (h, w) in enumerate([(1, 1), (5, 70), (33, 32), (64, 16), (90, 41), (7, 7)]):
        image = (rng.random((h, w)) < 0.4).astype(int) * rng.integers(1, 5, (h, w))
        if key == 4:
            image[16:60, :20] = 0
        pixels += [(key, x, y, int(image[y, x])) for y in range(h) for x in range(w) if image[y, x] or (y, x) == (h - 1, w - 1)]
        for x, y in {(0, 0), (-3, -5), (w - 4, h - 4), (w // 2 - 5, h // 2 - 5), (w, h), (-20, 0)} | {(int(a), int(b)) for a, b in rng.integers(-10, 90, (20, 2))}:
            tile_rows.append((key, w, h, x, y))
            want[key, x, y] = int(image[max(0, y) : max(0, y + 10), max(0, x) : max(0, x + 10)].sum())
    cells = spark.createDataFrame(pixels, "key int, x int, y int, value int")
    tile_table = spark.createDataFrame(tile_rows, "key int, w int, h int, x int, y int")
    got = {(r.key, r.x, r.y): r.total for r in raster.tile_sums(raster.summed_area(raster.blocks(cells, 16), 16), tile_table, 10, 16).collect()}
    assert got == want and len(got) == len(tile_rows)
    shares = raster.tissue_fractions(cells, tile_table, 10, 16).where("key = 3 and x = 0 and y = 0").first()
    assert shares.tissue_frac == want[3, 0, 0] / 100


def test_variants_of_the_protocol(spark):
    rows = spark.createDataFrame([(i, "g", i % 2, "train") for i in range(20)], "row_id long, grp string, label int, part string")
    assert {r.part for r in splits.image_split(rows, 1).collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError, match="official"):
        splits.image_split(rows, 1, official=True)
    records = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6), ("b", 1, 0.7)], "model string, seed int, value double")
    assert runs.record_of(records, model="a").first().value == 0.5
    for model in ("b", "none"):
        with pytest.raises(Exception, match="not exactly one record"):
            runs.record_of(records, model=model).collect()
    done = spark.createDataFrame([(1, "s", "g", None, None, None, [900, 20]), (2, "s", "g", None, None, None, [1000]), (3, "s", "g", "auc", "grouped", 5000, [5000]), (4, "s", "g", "logloss", None, 5000, [1]), (5, "old", "g", None, None, 5000, [1]), (6, "s", "g", None, "image", 5000, [1])], "k int, signature string, grid string, selection string, split string, max_iter int, iterations array<int>")
    assert sorted(r.k for r in lifecycle.finished(done, F.lit("s"), F.lit("g"), "auc", "grouped", 5000).collect()) == [1, 3]


def unit_rows(spark, n=300):
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("model"), F.array(F.col("id").cast("double")).alias("v"))


def test_units_are_replaced_whole(spark, tmp_path):
    """A run that fails midway publishes nothing, its repetition and a second one give each unit once; one unit is replaced alone."""
    path = str(tmp_path / "u")
    rows = unit_rows(spark).repartition(6)
    failing = rows.withColumn("row_id", F.when(F.col("row_id") == 250, F.raise_error(F.lit("lost"))).otherwise(F.col("row_id")))
    with pytest.raises(Exception, match="lost"):
        units.write_units(failing, path, "model", "s1")
    assert units.published(spark, path).count() == 0
    with pytest.raises(Exception, match="unfinished"):
        units.read_units(spark, path)
    for _ in range(2):
        units.write_units(rows, path, "model", "s1")
        assert sorted(r.row_id for r in units.read_units(spark, path, "s1").collect()) == list(range(300))
    assert sorted(map(tuple, units.published(spark, path).collect()), key=str) == [("1", "s1", 75), ("2", "s1", 75), ("3", "s1", 75), (None, "s1", 75)]
    with pytest.raises(Exception, match="lost"):
        units.write_units(failing, path, "model", "s2")
    assert units.read_units(spark, path, "s1").count() == 300
    units.write_units(rows.where("model = '2' and row_id < 50"), path, "model", "s1")
    assert units.read_units(spark, path, "s1", units=4).count() == 300 - 75 + 12
    with pytest.raises(Exception, match="4 of 5 units"):
        units.read_units(spark, path, units=5).count()
    units.write_units(rows.where("model = '2'"), path, "model", "s2")
    with pytest.raises(Exception, match="another index"):
        units.read_units(spark, path, "s1").count()


def test_many_units_share_files(spark, tmp_path):
    """The files of 3000 units, and the partitions that read them, don't grow with the units; replaced units' rows are left out of files they share."""
    path = str(tmp_path / "u")
    rows = spark.range(9000).select(F.col("id").alias("row_id"), (F.col("id") % 3000).alias("k"), F.lit("s").alias("mark"))
    units.write_units(rows, path, "k", signed="mark")
    assert sum(p.is_file() for p in (tmp_path / "u").rglob("*")) < 100 and units.read_units(spark, path).rdd.getNumPartitions() < 100
    units.write_units(rows.where("k % 3 = 0 and row_id < 3000").withColumn("mark", F.lit("t")), path, "k", signed="mark", shard=7)
    got = {r.row_id for r in units.read_units(spark, path, units=3000).collect()}
    assert got == {i for i in range(9000) if i % 3 or i < 3000}
    assert {(r.signature, r.rows): r["count"] for r in units.published(spark, path).groupBy("signature", "rows").count().collect()} == {("s", 3): 2000, ("t", 1): 1000}
    units.write_units(rows, path, "k", signed="mark")
    assert units.read_units(spark, path).count() == 9000 and len(list((tmp_path / "u" / units.LISTS).glob("*.json"))) == 1


def test_units_of_lost_files(spark, tmp_path):
    path = str(tmp_path / "u")
    units.write_units(unit_rows(spark), path, "model", "s")
    mark = units.marks(path)[0]
    (tmp_path / "u" / mark["folder"].rsplit("/", 1)[1] / mark["files"][0]["file"]).unlink()
    with pytest.raises(Exception, match="lacks files"):
        units.read_units(spark, path, "s").count()
    units.write_units(unit_rows(spark, 0), str(tmp_path / "none"), "model", "s")
    assert units.published(spark, str(tmp_path / "none")).count() == 0


def test_feature_scans_read_few_shards(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = unit_rows(spark, 1000)
    labels = rows.select("row_id", F.lit(1).alias("label"))
    mark = index.content_hash(labels, "row_id", F.col("label")).first()["content_hash"]
    runs.write_feature_units(rows.select("row_id", "v"), path, mark, shard_rows=50)
    few = runs.scan_features(spark, path, labels, first=410, last=455)
    assert sorted(r.row_id for r in few.collect()) == list(range(410, 456))
    assert few.rdd.getNumPartitions() <= 3 < 20 <= runs.scan_features(spark, path, labels).rdd.getNumPartitions()
    with pytest.raises(Exception, match="another index"):
        runs.scan_features(spark, path, labels.where("row_id > 0")).count()


def test_tile_index_is_guarded(spark, tmp_path):
    path = str(tmp_path / "t")
    tile_rows = spark.range(40).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("path"))
    runs.write_tile_index(tile_rows, path)
    spark.range(1).createOrReplaceTempView("some_tiles")
    assert runs.load_tile_index(spark, path, "some_tiles").count() == 40 and spark.sql("select max(path) as p from some_tiles").first().p == "t9"
    units.write_units(tile_rows.where("row_id < 39"), path, None, units.marks(path)[0]["signature"])
    with pytest.raises(ValueError, match="does not match its mark"):
        runs.load_tile_index(spark, path)


def test_resumed_runs_replace(spark, tmp_path):
    """Units that are there with their signature are left alone; others are made and replaced; a repeated run makes none."""
    path = str(tmp_path / "r")
    wanted = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "k int, m string, signature string")
    made = []

    def make(some):
        made.append(sorted(r.k for r in some.collect()))
        return some.select("k", "m", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))

    keys = ["k", "m"]
    done = lambda: resume.done_units(spark, path, "k int, m string")
    assert resume.run_pending(wanted, done(), keys, make, path) == 3
    assert resume.run_pending(wanted, done(), keys, make, path) == 0
    changed = wanted.withColumn("signature", F.when(F.col("k") == 2, "z").otherwise(F.col("signature")))
    assert resume.run_pending(changed, done(), keys, make, path) == 1
    assert made == [[1, 2, 3], [2]] and sorted((r.k, r.i) for r in resume.results(spark, path).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_pooling_as_shards_arrive(spark, tmp_path):
    """Shards in any order, in several runs and twice delivered give the means of the whole table; empty bags are errors."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 3))
    rows = [(i, int(i % 7), x[i].tolist()) for i in range(60)]
    whole = spark.createDataFrame(rows, "row_id long, bag int, v array<double>")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for at in ((40, 60), (0, 25), (0, 25), (20, 45)):
        whole.where(F.col("row_id").between(at[0], at[1] - 1)).coalesce(1).write.mode("append").parquet(source)
        shards.pool(spark, source, whole.schema, "bag", "row_id", "v", target, str(tmp_path / "log"))
    shards.pool(spark, source, whole.schema, "bag", "row_id", "v", target, str(tmp_path / "log"))
    got = {r.bag: r for r in shards.pooled(spark, target, "bag", "v", whole.select("bag").distinct()).collect()}
    assert set(got) == set(range(7))
    for b, r in got.items():
        own = x[np.arange(60) % 7 == b]
        assert r.n == len(own) and np.allclose(r.v, own.mean(0))
    with pytest.raises(Exception, match="no children: 9"):
        shards.pooled(spark, target, "bag", "v", spark.createDataFrame([(9,)], "bag int")).collect()


def test_chi2_tail():
    assert math.isclose(X.chi2_tail(6, 2), math.exp(-3), rel_tol=1e-12)
    assert math.isclose(X.chi2_tail(1, 1), math.erfc(math.sqrt(0.5)), rel_tol=1e-10)
    assert math.isclose(X.chi2_tail(20, 3), math.erfc(math.sqrt(10)) + math.sqrt(40 / math.pi) * math.exp(-10), rel_tol=1e-9)


def test_probe_is_optimal():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(120, 5)), rng.integers(0, 3, 120)
    w = probe.solve(x, y, 3, 0.5)
    z = np.concatenate([x, np.ones((120, 1))], 1)
    gradient = z.T @ (probe.probabilities(x, w) - np.eye(3)[y]) + np.r_[np.full((5, 1), 2.0), np.zeros((1, 1))] * w
    assert np.abs(gradient).max() < 1e-4


def test_selection(spark):
    scores = spark.createDataFrame([("m", 0.1, 0.7), ("m", 1.0, 0.7), ("m", 10.0, float("nan"))], "model string, c_value double, value double")
    assert probe.best_c(scores, ["model"]).first().c_value == 0.1
    history = spark.createDataFrame([("m", e, v) for e, v in enumerate([0.1, 0.5, 0.5, 0.4, 0.9])], "model string, epoch long, value double")
    r = probe.best_epoch(history, ["model"], patience=3).first()
    assert (r.best_epoch, r.best_value, r.last_epoch) == (4, 0.9, 4)
    assert probe.best_epoch(history, ["model"], patience=2).first().best_epoch == 1


def test_means_have_no_order(spark):
    """Means that lie on a tie are the same whatever the order of rows: 0.05375 is rounded up."""
    values = [0.01, 0.1, 0.07, 0.035] * 250
    for some in (values, values[::-1], sorted(values)):
        rows = spark.createDataFrame([(x,) for x in some], "x double").coalesce(1)
        assert rows.agg(catalog.exact_mean("x", 4)).first()[0] == 0.0538
    odd = spark.createDataFrame([(1, 0.5), (1, float("nan")), (2, None), (3, -0.00005), (3, None)], "k int, x double")
    got = {r.k: r.m for r in odd.groupBy("k").agg(catalog.exact_mean("x", 4).alias("m")).collect()}
    assert math.isnan(got[1]) and got[2] is None and got[3] == -0.0001


def test_best_c_adds_up_in_the_order_of_rows(spark, tmp_path):
    """Means on a tie fall as their SQL's do, which adds doubles up as the file holds them."""
    rng = np.random.default_rng(5)
    cents = rng.integers(0, 11, (400, 80))
    cents[:, -1] += (2 - cents.sum(1)) % 4  # so that all means end in five hundred-thousandths
    rows = [(m // 2, 1 + m % 2, c / 100) for i in range(80) for m, c in enumerate(cents[:, i].tolist())] + [(400, 1, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["best_c_select"]).fetchall()
    got = catalog.QUERIES["best_c_select"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want)


def test_negative_zeros_stay(spark):
    """Small negative cells round to negative zeros, as in SQL."""
    row = spark.createDataFrame([([-1e-9, 1e-9, -0.0, -0.25, None],)], "v array<double>").select(X.rounded_each(F.col("v"), 5)).first()[0]
    assert [math.copysign(1, x) for x in row[:4]] == [-1, 1, -1, -1] and row[3:] == [-0.25, None]


def test_attention_padding_free():
    rng = np.random.default_rng(4)
    v, u, w, bag = rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=(6, 4))
    share, pooled = vectors.attention_pool(v, u, w, bag)
    assert math.isclose(share.sum(), 1) and np.allclose(pooled, share @ bag)


def planted_bags(spark, parts=1):
    """Bags of three classes; one vector of each bag tells the class, the others are noise."""
    rng = np.random.default_rng(8)
    rows = []
    for bag in range(150):
        label = bag % 3
        items = rng.normal(size=(int(rng.integers(1, 9)), 6)) * 0.3
        items[rng.integers(len(items)), label] += 3
        rows.append(("m", bag, label, ("test", "val", "train", "train", "train")[bag // 3 % 5], items.tolist()))
    return spark.createDataFrame(rows, "model string, bag long, label int, part string, items array<array<double>>").repartition(parts)


def test_attention_gradients():
    rng = np.random.default_rng(9)
    s = attention.Settings(hidden=5, attention=4, dropout=0.5)
    w = attention.start(6, 3, s)
    x, mask = rng.normal(size=(4, 6)), attention.drawn_mask(s, 1, 7, 4)
    assert np.array_equal(mask, attention.drawn_mask(s, 1, 7, 4)) and set(np.unique(mask)) <= {0.0, 2.0}
    slope, at = attention.flat(attention.backward(w, x, 1, mask)[1]), attention.flat(w)
    for i in range(len(at)):
        ends = [attention.backward(attention.shaped(at + np.eye(len(at))[i] * e, w), x, 1, mask)[0] for e in (1e-6, -1e-6)]
        assert math.isclose((ends[0] - ends[1]) / 2e-6, slope[i], abs_tol=1e-5)


def test_attention_over_partitions(spark):
    """As a plain run over the same mini-batches; losses fall, the best epoch's weights score the test part."""
    s = attention.Settings(hidden=12, attention=6, epochs=5, patience=2, batch=40, rate=0.02, seed=3)
    bags = planted_bags(spark, 5)
    runs, found = attention.train(bags, ["model"], s)
    run = runs[("m",)]
    rows = {r.bag: r for r in bags.collect()}
    batches = -(-sum(r.part == "train" for r in rows.values()) // s.batch)
    plain = attention.Training(attention.start(6, 3, s))
    for epoch, loss, _ in run.history:
        place = {r.bag: r.b for r in bags.where("part = 'train'").select("bag", F.pmod(F.xxhash64(F.lit(s.seed), F.lit(epoch), "bag"), F.lit(batches)).alias("b")).collect()}
        total = 0.0
        for b in range(batches):
            own = [attention.backward(plain.w, np.array(rows[k]["items"]), rows[k].label, attention.drawn_mask(s, epoch, k, len(rows[k]["items"]))) for k in sorted(place) if place[k] == b]
            total += sum(x for x, _ in own)
            plain.step(sum(attention.flat(d) for _, d in own) / len(own), s)
        assert math.isclose(loss, total / len(place), rel_tol=1e-9)
        if epoch == run.best[1]:
            best = plain.w
    assert np.allclose(attention.flat(best), attention.flat(run.best[2]), atol=1e-9)
    assert run.history[-1][1] < run.history[0][1]
    assert run.best[0] == max(v for _, _, v in run.history) and run.best[1] == min(e for e, _, v in run.history if v == run.best[0])
    out = {r.bag: r for r in found.collect()}
    assert set(out) == {k for k, r in rows.items() if r.part == "test"}
    assert all(np.allclose(r.probs, attention.forward(best, np.array(rows[k]["items"]))[0]) for k, r in out.items())
    assert np.mean([int(np.argmax(r.probs)) == r.target for r in out.values()]) > 0.8


def test_attention_steps_read_their_bags(spark, monkeypatch):
    """A step reads the bags of its mini-batch alone; large mini-batches go to several tasks, with the same gradients."""
    s = attention.Settings(hidden=4, attention=3, batch=10, seed=5)
    w = {0: attention.start(6, 3, s)}
    rows = planted_bags(spark, 3).where("part = 'train'").withColumn("unit", F.lit(0))
    bags = attention.packed(rows)
    read = spark.sparkContext.accumulator(0)
    place = {r.bag: r.b for r in rows.select("bag", F.pmod(F.xxhash64(F.lit(5), F.lit(2), "bag"), F.lit(9)).alias("b")).collect()}
    for parts in (1, 3):
        drawn = attention.dealt(bags, 9, parts, 2, s).map(lambda r: read.add(1) or r)
        for b in range(9):
            before = read.value
            got = attention.gradients(drawn, range(b * parts, (b + 1) * parts), w, 2, s)
            own = [r for r in rows.collect() if place[r.bag] == b]
            assert read.value - before == len(own)
            want = sum(np.concatenate(([1.0, loss], attention.flat(d))) for loss, d in (attention.backward(w[0], np.array(r["items"]), r.label, attention.drawn_mask(s, 2, r.bag, len(r["items"]))) for r in own))
            assert np.allclose(got[0], want) if own else not got


def test_attention_stops(spark):
    t, s = attention.Training(attention.start(2, 2, attention.Settings(hidden=2, attention=2))), attention.Settings(patience=2)
    for epoch, value in enumerate([float("nan"), 0.5, 0.5, 0.4], 1):
        t.ended(epoch, 0.0, value, s)
    assert t.best[:2] == (0.5, 2) and t.done
    broken = planted_bags(spark).withColumn("items", F.when(F.col("bag") == 7, F.array().cast("array<array<double>>")).otherwise(F.col("items")))
    with pytest.raises(Exception, match="empty or broken bag 7"):
        attention.train(broken, ["model"], attention.Settings(hidden=2, attention=2, epochs=1))


def test_resume_and_stream(spark, tmp_path):
    wanted = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, signature string")
    done = spark.createDataFrame([(1, "x"), (3, "old")], "k int, signature string")
    assert {r.k for r in index.pending(wanted, done, ["k"]).collect()} == {2, 3}
    assert resume.run_pending(wanted, wanted, ["k"], lambda u: u, str(tmp_path / "none")) == 0
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "k long, v array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        shards.ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_report_text(spark):
    runs = spark.createDataFrame([("d", "m", s, "acc", v) for s, v in ((1, 0.5), (2, 0.7))] + [("d", "n", 1, "acc", 0.9)], "dataset string, model string, seed int, metric string, value double")
    text = {r.model: r.text for r in report.cells(report.seed_summary(runs)).collect()}
    assert text == {"m": "0.6000±0.1414", "n": "0.9000"}
