"""Queries of dataset indexes, stores, probe life cycles and further report frames; see ``catalog``."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .catalog import _BOOT, _COMPONENTS, _GRID, boot, features, pairs, predictions, probe_items, query, regions, rounded
from .functions.expressions import floating, let, norm, quantised, rounded_each, shown_p, total, unit_distance
from .operators import dedup, index, inference, lifecycle, metrics, quantiles, report, splits, tiles, vectors
from .plans import resume
from .sources import runs, storage
from .sources.storage import shared_dir, table
from .streaming import shards


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- dataset indexes ---------------------------------------------------------------


@query("""select p_partkey, 'SOB-' || p_size || '-' || p_partkey || 'CD-' || p_brand as name, p_partkey::varchar as patient from part""")
def index_patients(spark, d):
    name = F.concat(F.lit("SOB-"), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("CD-"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("patient", index.patient_of(F.col("name")))


@query("""select p_partkey, 's' || (p_partkey % 50) as slide, (p_size * 224)::int as x, (p_partkey % 9 * 224)::int as y, 's' || (p_partkey % 50) || '_' || (p_size * 224) as prefix from part""")
def index_tile_names(spark, d):
    stem = F.concat_ws("_", F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")), (F.col("p_size") * 224).cast("string"), (F.col("p_partkey") % 9 * 224).cast("string"))
    return table(spark, d, "part").select("p_partkey", index.tile_name(stem).alias("t"), index.slide_of(stem).alias("prefix")).select("p_partkey", "t.*", "prefix")


@query("""select o_orderkey, (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end)::int as label from orders""")
def index_one_hot(spark, d):
    flags = [(F.col("o_orderstatus") == s).cast("int") for s in ("F", "O", "P")]
    return table(spark, d, "orders").select("o_orderkey", index.one_hot_label(*flags).alias("label"))


@query("""select o_custkey as key, max(o_orderkey) as row_id, arg_max(o_totalprice, o_orderkey) as price, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1""")
def index_last_wins(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return index.last_wins(rows, "key", "row_id").select("key", "row_id", "price", "status")


@query("""select lang, count(distinct nullif(source, (select min(source) from documents)))::bigint as groups, count(*) as n from documents group by 1""")
def index_group_count(spark, d):
    docs = table(spark, d, "documents")
    blank = docs.agg(F.min("source").alias("blank"))  # one row
    rows = docs.join(F.broadcast(blank)).withColumn("grp", F.when(F.col("source") == F.col("blank"), "").otherwise(F.col("source")))
    return rows.groupBy("lang").agg(index.group_count("grp").alias("groups"), F.count("*").alias("n"))


@query("""with o as (select o_orderkey as row_id, 'w' || (o_custkey % 97) as slide, o_orderpriority[1]::int - 1 as seven, case o_orderstatus when 'F' then 'train' when 'O' then 'val' else 'test' end as part from orders)
select row_id, part, ('w' || (o.slide[2:]::int)) as slide, (o.slide[2:]::int % 13)::varchar as grp, (case when seven <= 1 then 0 when seven <= 3 then 1 else 2 end)::int as label from o""")
def index_official_parts(spark, d):
    """Three official parts put together, patients of their slides looked up strictly, fine classes collapsed to three ordered ones."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("w"), (F.col("o_custkey") % 97).cast("string")).alias("slide"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("seven"), "o_orderstatus")
    parts = [orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus").withColumn("part", F.lit(p)) for s, p in (("F", "train"), ("O", "val"), ("P", "test"))]
    sheet = spark.range(97).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("slide"), (F.col("id") % 13).cast("string").alias("grp"))
    rows = index.strict_lookup(parts[0].unionByName(parts[1]).unionByName(parts[2]), F.broadcast(sheet), "slide", "grp")
    return rows.select("row_id", "part", "slide", "grp", F.when(F.col("seven") <= 1, 0).when(F.col("seven") <= 3, 1).otherwise(2).alias("label"))


@query("""select doc_id as row_id, source as class_name, '' as grp, 'test' as part from documents where lang = 'en'""")
def index_external(spark, d):
    """An external set: one folder of the walk, no groups, everything test."""
    return table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("row_id"), F.col("source").alias("class_name"), F.lit("").alias("grp"), F.lit("test").alias("part"))


# --- duplicates ----------------------------------------------------------------------


LETTERS = "etaoinshrdlu"
_NEAR_SQL = f"""u as (select doc_id as id, [{", ".join(f"(length(text) - length(replace(text, '{x}', '')))::double" for x in LETTERS)}] as v from documents where text is not null),
un as (select id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-6)) as v from u),
nn as (select a.id as x, b.id as y, row_number() over (partition by a.id order by round(list_inner_product(a.v, b.v), 9) desc, b.id) as r from un a join un b on a.id <> b.id),
"""
_PIPELINE_SQL = _COMPONENTS.split(", v as (")[0].replace("where of_a <= 30 or of_b <= 30", "where of_a <= 1 or of_b <= 1") + ", " + _NEAR_SQL + """w as (select a, b from c union select least(x, y), greatest(x, y) from nn where r <= 2),
sh as (select a, b, count(*) as votes from w join f x on x.owner = a join f y on y.owner = b and y.feature = x.feature group by 1, 2), fz as (select owner, count(*) as size from f group by 1),
v as (select a, b from sh join fz x on x.owner = a join fz y on y.owner = b where votes >= 15 and votes::double / least(x.size, y.size) >= 0.5),
e as (select a, b from v union select b, a from v), reach(owner, x) as (select distinct a, a from e union select r.owner, e.b from reach r join e on r.x = e.a), roots as (select owner, min(x) as root from reach group by 1)"""


def letters(batches):
    """id and how often each of ``LETTERS`` is in a text; found in the bytes of all texts of a batch at once, where no other character holds theirs."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        counts = [np.diff(np.searchsorted(np.flatnonzero(data == ord(x)), ends - ends[0])) for x in LETTERS]
        v = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(counts, 1).ravel().astype(np.float64)), len(LETTERS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), v], names=["id", "v"])


def letter_vectors(spark, d):
    """Documents by their shares of some letters, at unit length: what they look like from afar."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text").mapInArrow(letters, "id long, v array<double>")
    return rows.withColumn("v", let(F.col("v"), lambda v: let(norm(v) + 1e-6, lambda n: F.transform(v, lambda x: x / n))))


@query(_PIPELINE_SQL + """, n as (select root, row_number() over (order by root) - 1 as k from (select distinct root from roots))
select owner, root, format('doc_src{:04d}', k) as grp from roots join n using (root)""")
def dup_pipeline(spark, d):
    """The whole way: the best candidate by votes, nearest vectors beside it, verification, components, names."""
    return dedup.pipeline(features(spark, d), letter_vectors(spark, d), "doc", most=1).select("owner", "root", "grp")


# --- stores ----------------------------------------------------------------------------


@query("""select vec_id as row_id, label, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total, len(embedding)::int as dims from embeddings""")
def features_loaded(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding")
    path = folder(spark, "features")
    labels = rows.select("row_id", "label")
    runs.write_features(rows.select("row_id", "embedding"), path, index.content_hash(labels, "row_id", F.col("label")).first()["content_hash"])
    return runs.load_features(spark, path, labels).select("row_id", "label", F.round(total(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("total"), F.size("embedding").alias("dims"))


@query("with recursive " + _BOOT + """ select dataset, seed, model, metric, round(value, 6) as value from boot where b = 0""")
def records_read_back(spark, d):
    """Run records written as JSON and read back, with one that can't be read beside them."""
    path = folder(spark, "records")
    runs.write_records(boot(spark, d).where("b = 0").drop("b"), path)
    spark.createDataFrame([('{"metric": "acc", "val', "x", "y", 1)], "value string, model string, dataset string, seed int").write.mode("append").partitionBy(*runs.UNIT).text(path)
    good, bad = runs.read_records(spark, path, "metric string, value double")
    if bad.count() != 1:
        raise ValueError("the broken record wasn't found")
    return rounded(good.select("dataset", "seed", "model", "metric", "value"), "value")


@query("with recursive " + _BOOT + """ select dataset, seed, model, round(max(value) filter (metric = 'acc'), 6) as acc from boot where b = 0 and (model <> 'cls' or seed = 42) and seed = 42 group by all""")
def predictions_read_back(spark, d):
    """Predictions stored by unit and read back: of seeds, those that every model has."""
    path = folder(spark, "predictions")
    runs.write_predictions(predictions(spark, d).where("model <> 'cls' or seed = 42"), path)
    rows = metrics.with_prediction(runs.read_predictions(spark, path).withColumn("probs", F.transform("probs", lambda x: F.round(x.cast("double"), 6))))
    return rows.groupBy("dataset", "seed", "model").agg(F.round(F.avg((F.col("pred") == F.col("target")).cast("double")), 6).alias("acc"))


@query("with recursive " + _BOOT + """, st as (select dataset, model, metric, seed, value as now, case when model = 'cls' and dataset = 'odd' then value / 2 else value end as then_ from boot where b = 0)
select dataset, model, case when model = 'patch_mean' then 'missing' when bool_and(printf('%.9f', now) = printf('%.9f', then_)) then 'fresh' else 'stale' end as state from st group by 1, 2""")
def stats_freshness(spark, d):
    """Statistics of two of three models; one model's runs have changed since."""
    values = boot(spark, d)
    point = values.where("b = 0")
    path = folder(spark, "stats")
    runs.write_stats(inference.intervals(values), pairs(spark, d), point.where("model <> 'patch_mean'"), path)
    changed = point.withColumn("value", F.when((F.col("model") == "cls") & (F.col("dataset") == "odd"), F.col("value") / 2).otherwise(F.col("value")))
    return runs.freshness(spark, path, changed)


@query("with recursive " + _BOOT + """, m as (select dataset, model, metric, avg(value) as mean from boot where b = 0 group by all) select dataset, model, metric, round(mean, 6) as mean from m where model = 'cls'""")
def report_mismatches(spark, d):
    """Means of the runs that the statistics state otherwise or not at all."""
    summary = report.seed_summary(boot(spark, d).where("b = 0")).select("dataset", "model", "metric", "mean")
    stats = summary.where("not (model = 'cls' and dataset = 'odd')").withColumn("mean", F.when(F.col("model") == "cls", F.col("mean") + 0.01).otherwise(F.col("mean")))
    return rounded(report.mismatches(summary, stats).select("dataset", "model", "metric", "mean"), "mean")


# --- probe life cycles ----------------------------------------------------------------


def units(spark, d):
    return vectors.variants(probe_items(spark, d).withColumnRenamed("v", "embedding"))


def stored_units(spark, d):
    def make():
        found = lifecycle.run_units(units(spark, d), ["model"])
        auc = metrics.auc_one_vs_rest(found, ["model", "c_value"])
        return auc.join(metrics.from_confusion(metrics.confusion(found, ["model"]), ["model"]), "model")

    return storage.once(spark, d, "probe-units", make)


@query()
def probe_life_cycle(spark, d):
    """model, c_value and test metrics of each unit: C by val, one refit, one test."""
    return stored_units(spark, d)


@query()
def probe_external(spark, d):
    """Each stored probe on vectors it has never seen (negated order of cells keeps their classes apart); guarded by the stored AUC."""
    moved = F.transform(F.col("v"), lambda x: x * 0.5 + 0.01)
    external = units(spark, d).where("model = 'official'").select("row_id", moved.alias("v"), "label")
    own = units(spark, d).where("model = 'official'")
    stored = stored_units(spark, d).where("model = 'official'").select("model", "c_value", "auc")
    found = lifecycle.outside(own, external, stored, ["model"])
    return metrics.auc_one_vs_rest(found, ["model"]).join(metrics.from_confusion(metrics.confusion(found, ["model"]), ["model"]), "model")


PRECISIONS = {"fp32": lambda v: v, "fp16": lambda v: floating(v, 11, -14, 65504.0), "bf16": lambda v: floating(v, 8, -126, 3.3895313892515355e38), "int8": lambda v: quantised(v, 8), "int4": lambda v: quantised(v, 4)}


@query()
def probe_precisions(spark, d):
    """model, kind, auc, agreement with single precision: one refit, five ways of rounding."""
    found = lifecycle.precisions(units(spark, d), stored_units(spark, d), ["model"], PRECISIONS)
    pred = metrics.with_prediction(found).select("model", "kind", "row_id", "pred")
    same = pred.join(pred.where("kind = 'fp32'").select("model", "row_id", F.col("pred").alias("exact")), ["model", "row_id"])
    share = same.groupBy("model", "kind").agg(F.avg((F.col("pred") == F.col("exact")).cast("double")).alias("agreement"))
    return metrics.auc_one_vs_rest(found, ["model", "kind"]).join(share, ["model", "kind"])


# --- further frames -----------------------------------------------------------------------


@query("with recursive " + _BOOT + """, m as (select dataset, model, max(value) filter (metric = 'auc') as auc, max(value) filter (metric = 'qwk') as qwk from sm where b = 0 group by all)
select model, round(max(case when dataset = 'even' then qwk end), 6) as even, round(max(case when dataset = 'odd' then auc end), 6) as odd from m group by 1""")
def report_benchmark(spark, d):
    """A row for each model, a column for each data set: QWK where classes are ordered, else AUC."""
    values = inference.over_seeds(boot(spark, d)).where("b = 0")
    primary = [(name, metrics.primary_metric(name, frozenset({"even"}))) for name in ("even", "odd")]
    wanted = values.where(" or ".join(f"(dataset = '{n}' and metric = '{m}')" for n, m in primary))
    return rounded(report.wide(wanted, ["model"], "dataset", "value", ["even", "odd"]), "even", "odd")


@query("with recursive " + _BOOT + """, m as (select dataset, model, value from sm where b = 0 and metric = 'qwk')
select dataset, model, round(value, 6) as value, round((value - min(value) over (partition by dataset)) / nullif(max(value) over (partition by dataset) - min(value) over (partition by dataset), 0), 6) as shade, (rank() over (partition by dataset order by round(value, 9) desc) = 1) as best from m""")
def report_heatmap(spark, d):
    values = rounded(inference.over_seeds(boot(spark, d)).where("b = 0 and metric = 'qwk'"), "value", digits=9)
    return rounded(report.heatmap(values), "value", "shade")


@query("with recursive " + _BOOT + """, m as (select dataset, model, max(value) filter (b = 0) as mean, quantile_cont(value, 0.025) filter (b > 0) as lo, quantile_cont(value, 0.975) filter (b > 0) as hi from sm where metric = 'acc' group by all)
select dataset, model, row_number() over (partition by dataset order by round(mean, 9) desc, model)::int as place, round(mean, 6) as mean, round(mean - lo, 6) as below, round(hi - mean, 6) as above from m""")
def report_bars(spark, d):
    ci = inference.intervals(boot(spark, d)).where("metric = 'acc'")
    return rounded(report.bars(ci), "mean", "below", "above")


@query("""with t as (select l_returnflag as family, l_suppkey as test, round(count(*) / 4003.0, 6)::double as p from lineitem group by 1, 2)
select family, test, p, case when p < 0.001 then '<0.001' else printf('%.3f', p) end as text from t""")
def shown_p_values(spark, d):
    tests = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("test")).agg(F.round(F.count("*") / 4003.0, 6).alias("p"))
    return tests.withColumn("text", shown_p(F.col("p")))


@query("""select a.vec_id as id, round(sqrt(greatest(0.0, 2 - 2 * round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9))), 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_distance(spark, d):
    from .functions.expressions import cosine

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select(F.col("vec_id").alias("id"), F.round(unit_distance(F.round(cosine(F.col("v"), F.col("w")), 9)), 6).alias("distance"))


@query("""select 'orders' as step, 'done' as state, count(*)::varchar as note from orders union all select 'labels', 'done', (select count(distinct label)::varchar from embeddings) union all select 'broken', 'failed', ''""")
def report_ledger(spark, d):
    """step, state, note of report steps of which one fails; the others are done all the same."""
    steps = {"orders": lambda: table(spark, d, "orders").count(), "broken": lambda: table(spark, d, "no_such_table").count(), "labels": lambda: table(spark, d, "embeddings").select("label").distinct().count()}
    done, notes = report.ledger(steps)
    return spark.createDataFrame([(n, "done", str(v)) for n, v in done.items()] + [(n, kind, "") for n, kind, _ in notes], "step string, state string, note string")


# --- published units ----------------------------------------------------------------------


@query("""select l_suppkey as k, l_returnflag as flag, count(*) as n, sum(l_quantity)::double as quantity from lineitem group by 1, 2""")
def units_resumed(spark, d):
    """Units (suppliers) of which some are there, some from other inputs and some not; a run makes the latter two, and a repeated run none."""
    path = folder(spark, "resumed")
    rows = table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey").cast("long"))
    make = lambda some: rows.join(some.select("k"), "k", "left_semi").groupBy("k", F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))
    wanted = rows.groupBy("k").agg(F.concat_ws(":", F.count("*"), F.max("l_orderkey")).alias("signature"))
    half = wanted.where("k % 2 = 0")
    old = half.withColumn("signature", F.when(F.col("k") % 4 == 0, "old").otherwise(F.col("signature")))
    nothing = wanted.limit(0)
    resume.run_pending(old, nothing, ["k"], lambda some: make(some).withColumn("n", F.when(F.col("k") % 4 == 0, F.lit(-1).cast("long")).otherwise(F.col("n"))), path)
    done = lambda: resume.done_units(spark, path, "k long")
    made = resume.run_pending(wanted, done(), ["k"], make, path)
    if not made or resume.run_pending(wanted, done(), ["k"], make, path):
        raise ValueError("pending units were not found")
    return resume.results(spark, path).select("k", "flag", "n", "quantity")


@query(_GRID + " select roi_row || '_' || x || '_' || y as path, roi_row, x::int as x, y::int as y from g")
def tile_index_guarded(spark, d):
    """The tile index, published with the hash of its paths, checked as it is read, and found by queries under its name."""
    path = folder(spark, "tile-index")
    grid = tiles.grid(regions(spark, d)).select(F.concat_ws("_", "roi_row", "x", "y").alias("path"), "roi_row", "x", "y")
    place = (F.col("roi_row") * 1000 + F.floor((F.col("y") + 224) / 224) * 30 + F.floor((F.col("x") + 224) / 224)).cast("long")
    runs.write_tile_index(grid.withColumn("row_id", place), path)
    runs.load_tile_index(spark, path, "bracs_tiles")
    return spark.sql("select path, roi_row, x, y from bracs_tiles")


@query("""select label as bag, count(*) as n, round(avg(embedding[1]::double), 6) as first, round(avg(embedding[64]::double), 6) as last, round(avg(list_sum(list_transform(embedding, lambda x: x::double))), 5) as total from embeddings group by 1""")
def pool_stream(spark, d):
    """Mean vectors of bags whose shards arrive in two deliveries, of which one brings rows of the other again."""
    source, target, log = (folder(spark, f"pool-{x}") for x in ("in", "out", "log"))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("bag"), "embedding")
    for part in ("vec_id % 3 <> 0", "vec_id % 3 <> 1"):
        rows.where(part).write.mode("append").parquet(source)
        shards.pool(spark, source, rows.schema, "bag", "vec_id", "embedding", target, log)
    found = shards.pooled(spark, target, "bag", "v", rows.select("bag").distinct())
    return found.select("bag", "n", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"), F.round(total("v"), 5).alias("total"))


# --- protocol variants, look-ups, further frames ------------------------------------------


@query("""with a as (select doc_id as row_id, lang as label, row_number() over (partition by lang order by md5('7:' || doc_id), doc_id) <= floor(count(*) over (partition by lang) * 0.2 + 0.5) as test from documents),
b as (select *, row_number() over (partition by label order by md5('7:val:' || row_id), row_id) <= floor(count(*) over (partition by label) * 0.2 + 0.5) as val from a where not test)
select row_id, label, 'test' as part from a where test union all select row_id, label, case when val then 'val' else 'train' end from b""")
def split_image(spark, d):
    """Documents split row by row, their sources ignored."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), F.col("source").alias("grp"))
    return splits.image_split(rows, 7).select("row_id", "label", "part")


@query("""with r as (select l_orderkey, l_linenumber, l_linestatus as signature, l_returnflag as grid, case when l_linenumber < 4 then case when l_suppkey % 2 = 0 then 'auc' else 'logloss' end end as selection, case when l_linenumber % 2 = 0 then 'image' end as split, (l_quantity * 100)::int as max_iter, [l_linenumber * 300, l_suppkey * 20] as iterations from lineitem)
select l_orderkey, l_linenumber::int as l_linenumber from r where signature = 'O' and grid = 'N' and coalesce(selection, 'auc') = 'auc' and coalesce(split, 'grouped') = 'grouped' and (max_iter >= 3000 or list_max(iterations) < max_iter)""")
def units_done(spark, d):
    """Lines as run records: those of the present inputs and protocol whose fits all converged."""
    n = F.col("l_linenumber")
    r = table(spark, d, "lineitem").select("l_orderkey", n.cast("int").alias("l_linenumber"), F.col("l_linestatus").alias("signature"), F.col("l_returnflag").alias("grid"), F.when(n < 4, F.when(F.col("l_suppkey") % 2 == 0, "auc").otherwise("logloss")).alias("selection"), F.when(n % 2 == 0, "image").alias("split"), (F.col("l_quantity") * 100).cast("int").alias("max_iter"), F.array((n * 300).cast("long"), (F.col("l_suppkey") * 20).cast("long")).alias("iterations"))
    return lifecycle.finished(r, F.lit("O"), F.lit("N"), "auc", "grouped", 3000).select("l_orderkey", "l_linenumber")


@query(_GRID + """, each as (select roi_row, roi_row % 3 as class, roi_row % 2 as part, count(*) as tiles from g group by 1, 2, 3)
select class, part, count(*) as regions, sum(tiles)::bigint as tiles, quantile_cont(tiles, 0.5) as median, round(avg(tiles), 2) as mean from each group by 1, 2""")
def tile_counts(spark, d):
    """Tiles of regions by class and part: sum, median, mean."""
    each = tiles.grid(regions(spark, d)).groupBy("roi_row").agg(F.count("*").alias("tiles")).withColumns({"class": F.col("roi_row") % 3, "part": F.col("roi_row") % 2})
    sums = each.groupBy("class", "part").agg(F.count("*").alias("regions"), F.sum("tiles").alias("tiles"), F.round(F.avg("tiles"), 2).alias("mean"))
    middle = quantiles.quantiles(each, ["class", "part"], "tiles", (0.5,)).select("class", "part", F.get("values", F.lit(0)).alias("median"))
    return sums.join(middle, ["class", "part"])


@query(_GRID + " select roi_row, x::int as x, y::int as y from g qualify row_number() over (partition by roi_row order by y, x) = 1")
def first_tiles(spark, d):
    """The first tile of each region in raster order."""
    one = tiles.grid(regions(spark, d)).groupBy("roi_row").agg(F.min(F.struct("y", "x")).alias("t"))
    return one.select("roi_row", F.col("t.x").alias("x"), F.col("t.y").alias("y"))


@query("""select lang, source, count(*) as n from (select lang, source, doc_id from documents where doc_id % 3 > 0 union select lang, source, doc_id from documents where doc_id % 2 = 0) group by 1, 2""")
def union_distinct(spark, d):
    """Two overlapping tables one after the other, repeated rows dropped."""
    rows = table(spark, d, "documents").select("lang", "source", "doc_id")
    both = rows.where("doc_id % 3 > 0").unionByName(rows.where("doc_id % 2 = 0")).dropDuplicates()
    return both.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""with t as (select vec_id, list_transform(range(0, 8), lambda i: list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: x::double)) as t from embeddings)
select vec_id, list_transform(list_concat(t[1], list_transform(range(1, 9), lambda j: (t[3][j] + t[4][j] + t[5][j] + t[6][j] + t[7][j] + t[8][j]) / 6)), lambda x: round(x, 6)) as v from t""")
def token_features(spark, d):
    """Vectors as eight tokens, of which the first is the class token and the second a register."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    return table(spark, d, "embeddings").select("vec_id", rounded_each(vectors.token_features(tokens, 2), 6).alias("v"))


@query("with recursive " + _BOOT + """ select dataset, seed, model, metric, round(value, 6) as value from boot where b = 0 and dataset = 'odd' and seed = 43 and model = 'cls' and metric = 'auc'""")
def record_lookup(spark, d):
    """One run record by its key."""
    found = runs.record_of(boot(spark, d).where("b = 0").drop("b"), dataset="odd", seed=43, model="cls", metric="auc")
    return rounded(found.select("dataset", "seed", "model", "metric", "value"), "value")


@query("""with b as (select doc_id // 1024 as block, sha256(string_agg(source || ':' || lang, chr(10) order by doc_id, source || ':' || lang) || chr(10)) as digest from documents group by 1),
h as (select sha256(string_agg(digest, chr(10) order by block) || chr(10)) as h from b) select substr(sha256('probe' || chr(10) || '0.1' || chr(10) || h), 1, 16) as signature from h""")
def external_signature(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("path"), F.col("lang").alias("label"))
    return index.external_signature(rows, "probe", 0.1)


@query("with recursive " + _BOOT + """, m as (select dataset, model, avg(value) as mean from boot where b = 0 and metric = 'acc' and model <> 'official' group by all)
select model, round(max(mean) filter (dataset = 'even'), 6) as even, round(max(mean) filter (dataset = 'odd'), 6) as odd from m group by 1""")
def report_additional(spark, d):
    """Models beside the main ones."""
    summary = report.seed_summary(boot(spark, d).where("b = 0 and metric = 'acc'"))
    return rounded(report.additional_models(summary, ["official"], ["even", "odd"]), "even", "odd")
