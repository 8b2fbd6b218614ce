"""All queries of the evaluation engine by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.expressions import argmax, centred_unit, cosine, dot, floating, hash_int, is_tissue, quantised, root_normalised, rounded_each, softmax, symmetries
from .operators import attention, dedup, geometry, index, inference, metrics, probe, quantiles, report, splits, tiles, vectors
from .operators import raster as rasters
from .operators.softmax import fit as fit_probes
from .sources.storage import once, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REPLICATES = 1000


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def exact_mean(column: str, digits: int):
    """Mean rounded half up to ``digits``, of sums of whole hundred-millionths: no order of rows and no partition moves a tie.

    Values that aren't finite, or of a million and more, are averaged as they are.
    """
    x, n = F.col(column), F.count(column)
    plain = F.abs(x) < 1e6
    whole = F.sum(F.when(plain, F.round(x * 1e8, 0).cast("long")))
    unit = n * 10 ** (8 - digits)
    up = 2 * F.abs(whole) + unit
    exact = (up - up % (2 * unit)) / (2 * unit) * F.signum(whole.cast("double")) / 10.0**digits
    return F.when(F.count(F.when(plain, 1)) == n, exact).otherwise(F.round(F.avg(x), digits))


def sequential_mean(rows: DataFrame, keys: list[str], column: str, digits: int) -> DataFrame:
    """keys, value: means of a column, summed up in doubles in the order of (file, place), as one reader of the files sums them up, and rounded as DuckDB rounds.

    On a tie of decimals that order decides.  Rows are sorted and added one by one; no group is held in memory.
    """
    order = W.partitionBy(*keys).orderBy("file", "place").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.withColumn("sum", F.sum(column).over(order)).withColumn("at", F.count("*").over(order))
    means = sums.groupBy(*keys).agg((F.max_by("sum", "at") / F.count(column)).alias("mean"))
    return means.select(*keys, (F.round(F.col("mean") * 10.0**digits, 0) / 10.0**digits).alias("value"))


# --- indexes, names, look-ups -------------------------------------------------


@query("""select doc_id, lang as class_name, (dense_rank() over (order by lang) - 1)::int as label from documents""")
def index_class_codes(spark, d):
    return index.class_codes(table(spark, d, "documents").select("doc_id", F.col("lang").alias("class_name")))


@query(r"""select page_id, regexp_extract(url, '^(\w+)://', 1) as scheme, regexp_extract(url, '^\w+://([^/]+)/', 1) as host,
  regexp_extract(url, '^\w+://[^/]+/(\w+)/', 1) as class_name, try_cast(regexp_extract(url, '/(\d+)', 1) as bigint) as number from pages""")
def index_parse_name(spark, d):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", part(r"^(\w+)://").alias("scheme"), part(r"^\w+://([^/]+)/").alias("host"), part(r"^\w+://[^/]+/(\w+)/").alias("class_name"), part(r"/(\d+)").try_cast("bigint").alias("number"))


@query("""select md5(text) as key, count(*) as n from documents group by 1 having count(*) > 1""")
def index_validate_dups(spark, d):
    return index.repeated(table(spark, d, "documents"), F.md5("text"))


@query("""with b as (select doc_id // 1024 as block, sha256(string_agg(coalesce(lang, ''), chr(10) order by doc_id, lang) || chr(10)) as digest from documents group by 1)
select sha256(string_agg(digest, chr(10) order by block) || chr(10)) as content_hash, count(*) as n_blocks from b""")
def index_content_hash(spark, d):
    return index.content_hash(table(spark, d, "documents"), "doc_id", F.col("lang"))


@query("""select substr(sha256('{''tissue_min'': 0.1}' || string_agg(s_name, chr(10) order by s_suppkey) || string_agg(s_nationkey::varchar, chr(10) order by s_suppkey)
  || string_agg((s_suppkey % 7)::varchar, chr(10) order by s_suppkey) || string_agg('', chr(10) order by s_suppkey)), 1, 16) as signature from supplier""")
def index_signature(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("path"), F.col("s_nationkey").alias("label"), (F.col("s_suppkey") % 7).alias("grp"), F.lit("").alias("part"))
    return index.data_signature(rows, 0.1)


@query("""select c_custkey, c_nationkey, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def lookup_join_strict(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return index.strict_lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "nation").select("c_custkey", "c_nationkey", "nation", "region")


@query("""select p_brand as brand, count(*) as n, count(*) filter (p_partkey is null) as orphans, round(sum(l_quantity), 2) as quantity from lineitem left join part on l_partkey = p_partkey group by 1""")
def left_join_tiles(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    joined = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy("brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_partkey").isNull()).alias("orphans"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""select doc_id as row_id, coalesce(case quality when 1 then 'train' when 0 then 'test' end, 'excluded') as part from documents left join labels using (doc_id)""")
def scatter_excluded(spark, d):
    parts = table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "test").alias("part"))
    return splits.manifest(table(spark, d, "documents").select(F.col("doc_id").alias("row_id")), parts)


@query("""select source, count(*) as pending from documents where doc_id not in (select doc_id from labels) group by 1""")
def semi_anti_pending(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.lit("v1").alias("signature"))
    wanted = table(spark, d, "documents").select("doc_id", "source", F.lit("v1").alias("signature"))
    return index.pending(wanted, done, ["doc_id"]).groupBy("source").agg(F.count("*").alias("pending"))


@query("""with a as (select distinct user_id from events where value >= 50), b as (select distinct user_id from events where event_type = 'purchase')
select (select count(*) from (from a intersect from b)) as both_sets, (select count(*) from (from a union from b)) as any_set, (select count(*) from (from a except from b)) as only_first""")
def set_ops_groups(spark, d):
    events = table(spark, d, "events")
    a, b = (events.where(c).select("user_id").distinct() for c in ("value >= 50", "event_type = 'purchase'"))
    marked = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "user_id", "full")
    return marked.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both_sets"), F.count("*").alias("any_set"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_first"))


@query("""select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)""")
def relational_division(spark, d):
    events = table(spark, d, "events")
    kinds = events.select(F.countDistinct("event_type").alias("wanted"))
    found = events.groupBy("user_id").agg(F.countDistinct("event_type").alias("wanted"))
    return found.join(kinds, "wanted", "left_semi").select("user_id")


# --- quality, tiles ------------------------------------------------------------


@query("""with q as (select doc_id, lang as dataset, round(length(regexp_replace(text, '[^a-z]', '', 'g'))::double / length(text), 4) as tissue_frac from documents where length(text) > 0)
select * from q where dataset not in ('en', 'de') or (dataset = 'en' and tissue_frac >= 0.7) or (dataset = 'de' and tissue_frac >= 0.75)""")
def quality_filter(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    letters = F.length(F.regexp_replace("text", "[^a-z]", "")).cast("double")
    return tiles.usable(docs.select("doc_id", F.col("lang").alias("dataset"), F.round(letters / F.length("text"), 4).alias("tissue_frac")), {"en": 0.7, "de": 0.75})


@query("""select lang, quantile_cont(n_chars, 0.05) as q05, quantile_cont(n_chars, 0.5) as q50, quantile_cont(n_chars, 0.95) as q95 from documents group by 1""")
def quality_quantiles(spark, d):
    shares = (0.05, 0.5, 0.95)
    found = quantiles.quantiles(table(spark, d, "documents"), ["lang"], "n_chars", shares)
    return found.select("lang", *(F.get("values", F.lit(i)).alias(f"q{round(100 * q):02d}") for i, q in enumerate(shares)))


@query("""select o_orderstatus as status, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as sd, min(o_totalprice) as low,
  round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.75), 4) as p75, max(o_totalprice) as high from orders group by 1""")
def describe_stats(spark, d):
    x = "o_totalprice"
    rows = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    out = rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    found = quantiles.quantiles(rows, ["status"], x, (0.25, 0.5, 0.75)).drop("n")
    return out.join(found, "status").select("status", "n", "mean", "sd", "low", *(F.round(F.get("values", F.lit(i)), 4).alias(p) for i, p in enumerate(("p25", "p50", "p75"))), "high")


@query("""select l_returnflag as flag, least(9, floor(l_extendedprice / 10000))::bigint as bin, count(*) as n from lineitem group by 1, 2""")
def histogram_bins(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.least(F.lit(9), F.floor(F.col("l_extendedprice") / 10000)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def regions(spark, d):
    """Parts as image regions: width and height follow from their key and size."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("roi_row"), (F.lit(150) + F.col("p_size") * 14).cast("int").alias("w"), (F.lit(120) + (F.col("p_partkey") % 40) * 17).cast("int").alias("h"))


_GRID = """with r as (select p_partkey as roi_row, (150 + p_size * 14)::int as w, (120 + (p_partkey % 40) * 17)::int as h from part),
n as (select *, greatest(1, w // 224) as nx, greatest(1, h // 224) as ny from r),
g as (select roi_row, w, h, floor((w - nx * 224) / 2.0)::int + i * 224 as x, floor((h - ny * 224) / 2.0)::int + j * 224 as y
  from (select *, unnest(range(0, nx)) as i from n) a, lateral (select unnest(range(0, a.ny)) as j) b)"""


@query(_GRID + " select roi_row, w, h, x::int as x, y::int as y from g")
def tile_grid(spark, d):
    return tiles.grid(regions(spark, d))


#: Whole numbers up to the one division, so every engine rounds alike: a thousandth of 0 to 0.4 of the tile's area, in millionths.
_FRACTION = """t as (select *, ((('0x' || substr(md5(roi_row || ':' || x || ':' || y), 1, 8))::bigint % 1000
  * greatest(0, least(x + 224, w) - greatest(x, 0)) * greatest(0, least(y + 224, h) - greatest(y, 0)) * 400 + 25088) // 50176) / 1000000.0::double as tissue_frac from g)"""


@query(_GRID + ", " + _FRACTION + """, b as (select *, row_number() over (partition by roi_row order by tissue_frac desc, y, x) as k, max(tissue_frac) over (partition by roi_row) as top from t)
select roi_row, w, h, x::int as x, y::int as y, tissue_frac, (case when top < 0.1 and k = 1 then 1 else 0 end)::int as fallback from b where tissue_frac >= 0.1 or (top < 0.1 and k = 1)""")
def tile_filter_fallback(spark, d):
    g = tiles.grid(regions(spark, d))
    cells = hash_int(F.col("roi_row"), F.col("x"), F.col("y")) % 1000 * tiles.area(F.col("w"), F.col("h"), F.col("x"), F.col("y"))
    g = g.withColumn("cells", cells.cast("long")).withColumn("tissue_frac", F.expr("((cells * 400 + 25088) div 50176) / 1000000.0D")).drop("cells")
    return tiles.kept_tiles(g, "roi_row")


@query("""with px as (select p_partkey as row_id, unnest(range(0, 16)) as i from part),
c as (select row_id, ('0x' || substr(md5(row_id || ':' || i), 1, 2))::int as r, ('0x' || substr(md5(row_id || ':' || i), 3, 2))::int as g, ('0x' || substr(md5(row_id || ':' || i), 5, 2))::int as b from px)
select row_id, round(avg(case when greatest(r, g, b) - least(r, g, b) > 15 and greatest(r, g, b) > 30 then 1.0 else 0.0 end), 4) as tissue_frac,
  round(avg(case when greatest(r, g, b) = 0 then 1.0 else 0.0 end), 4) as black_frac, round(avg(case when least(r, g, b) > 220 then 1.0 else 0.0 end), 4) as white_frac from c group by 1""")
def pixel_fractions(spark, d):
    # a hash a pixel, of which three bytes are its colours; the table is small, so rows are dealt to all cores
    channel = lambda h, bits: F.shiftright(h, bits).bitwiseAND(F.lit(255).cast("long")).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: hash_int(F.col("p_partkey"), i))
    pixels = F.transform(hashes, lambda h: F.struct(channel(h, 24).alias("r"), channel(h, 16).alias("g"), channel(h, 8).alias("b")))
    rows = table(spark, d, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return rows.select(F.col("p_partkey").alias("row_id"), tiles.pixel_fractions(pixels).alias("x")).select("row_id", "x.*")


RASTER, RASTER_TILE = 24, 10


def raster(spark, d):
    """Suppliers as regions, their lines as pixels, row by row; key, x, y, value (1: tissue) and the tiles of each region."""
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    at = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), place.alias("i"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_linenumber") * 30).cast("int").alias("g"), (F.col("l_partkey") % 200).cast("int").alias("b"))
    pixels = at.select("key", (F.col("i") % RASTER).alias("x"), F.floor(F.col("i") / RASTER).cast("int").alias("y"), is_tissue(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("value"))
    regions = pixels.groupBy("key").agg(F.lit(RASTER).alias("w"), (F.max("y") + 1).alias("h"))
    return pixels, tiles.grid(regions, RASTER_TILE)


@query(f"""with p as (select l_suppkey as key, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as i, (l_quantity * 5)::int as r, (l_linenumber * 30)::int as g, (l_partkey % 200)::int as b from lineitem),
px as (select key, i % {RASTER} as x, i // {RASTER} as y, case when greatest(r, g, b) - least(r, g, b) > 15 and greatest(r, g, b) > 30 then 1 else 0 end as v from p),
rg as (select key, {RASTER} as w, max(y) + 1 as h from px group by 1), n as (select *, greatest(1, w // {RASTER_TILE}) as nx, greatest(1, h // {RASTER_TILE}) as ny from rg),
g as (select key, w, h, floor((w - nx * {RASTER_TILE}) / 2.0)::int + i * {RASTER_TILE} as x, floor((h - ny * {RASTER_TILE}) / 2.0)::int + j * {RASTER_TILE} as y from (select *, unnest(range(0, nx)) as i from n) a, lateral (select unnest(range(0, a.ny)) as j) b)
select g.key, g.x::int as x, g.y::int as y, round(sum(coalesce(v, 0)) / {float(RASTER_TILE**2)}, 6)::double as tissue_frac from g left join px on px.key = g.key and px.x >= g.x and px.x < g.x + {RASTER_TILE} and px.y >= g.y and px.y < g.y + {RASTER_TILE} group by 1, 2, 3""")
def tile_tissue(spark, d):
    """Tissue fractions of tiles counted from pixels, by summed-area tables."""
    pixels, grid = raster(spark, d)
    return rounded(rasters.tissue_fractions(pixels, grid, RASTER_TILE, 16).select("key", "x", "y", "tissue_frac"), "tissue_frac")


# --- duplicates ----------------------------------------------------------------


def matched_points(spark, d):
    """Suppliers paired with the next one; lines as matched points: of two thirds of the pairs, the first three lines of an order follow the pair's transform."""
    k = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("a"), k.alias("k"), (F.col("l_extendedprice") % 384).cast("double").alias("x"), (F.col("l_partkey") * 7 % 384).cast("double").alias("y"), "l_linenumber")
    noise = lambda name: (hash_int(F.col("a"), F.col("k"), F.lit(name)) % 384).cast("double")
    scale, turn = F.lit(1.0) + F.col("a") % 5 * 0.1, F.col("a") * 0.3
    planted = (F.col("a") % 3 > 0) & (F.col("l_linenumber") <= 3)
    u = scale * (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y")) + F.col("a") % 50
    v = scale * (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y")) - F.col("a") % 20
    return rows.select("a", (F.col("a") + 1).alias("b"), "k", "x", "y", F.when(planted, u).otherwise(noise("u")).alias("u"), F.when(planted, v).otherwise(noise("v")).alias("v"))


@query("""with p as (select l_suppkey::bigint as a, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as k, (l_extendedprice % 384)::double as x, (l_partkey * 7 % 384)::double as y, l_linenumber from lineitem),
m as (select a, a + 1 as b, k, x, y, case when a % 3 > 0 and l_linenumber <= 3 then (1.0 + a % 5 * 0.1)::double * (cos(a * 0.3) * x - sin(a * 0.3) * y) + a % 50 else ('0x' || substr(md5(a || ':' || k || ':u'), 1, 8))::bigint % 384 end as u,
  case when a % 3 > 0 and l_linenumber <= 3 then (1.0 + a % 5 * 0.1)::double * (sin(a * 0.3) * x + cos(a * 0.3) * y) - a % 20 else ('0x' || substr(md5(a || ':' || k || ':v'), 1, 8))::bigint % 384 end as v from p),
n as (select a, b, count(*) as n from m group by 1, 2), h as (select a, b, h, ('0x' || substr(md5(a || ':' || b || ':' || h || ':0'), 1, 8))::bigint % n as i, ('0x' || substr(md5(a || ':' || b || ':' || h || ':1'), 1, 8))::bigint % n as j from n, (select unnest(range(0, 128)) as h)),
e as (select h.a, h.b, h, i.x as px, i.y as py, i.u as pu, i.v as pv, j.x - i.x as dx, j.y - i.y as dy, j.u - i.u as du, j.v - i.v as dv from h join m i on i.a = h.a and i.k = h.i join m j on j.a = h.a and j.k = h.j),
s as (select a, b, h, px, py, pu, pv, (du * dx + dv * dy) / (dx * dx + dy * dy) as re, (dv * dx - du * dy) / (dx * dx + dy * dy) as im from e where dx <> 0 or dy <> 0),
t as (select a, b, h, re, im, pu - (re * px - im * py) as tx, pv - (im * px + re * py) as ty from s),
c as (select t.a, t.b, h, count(*) filter (sqrt(power(re * x - im * y + tx - u, 2) + power(im * x + re * y + ty - v, 2)) <= 3.0) as inliers, any_value(re) as re, any_value(im) as im, any_value(tx) as tx, any_value(ty) as ty from t join m on m.a = t.a group by 1, 2, 3),
w as (select * from c qualify row_number() over (partition by a, b order by inliers desc, h) = 1)
select n.a, n.b, n.n as matches, coalesce(inliers, 0) as inliers, coalesce(inliers, 0) >= 15 as kept, case when inliers >= 15 then round(sqrt(re * re + im * im), 6) end as scale, case when inliers >= 15 then round(atan2(im, re), 6) end as turn,
  case when inliers >= 15 then round(tx, 5) end as dx, case when inliers >= 15 then round(ty, 5) end as dy from n left join w using (a, b)""")
def pair_geometry(spark, d):
    """Pairs verified by the similarity transform that most of their matched points agree on."""
    return rounded(rounded(geometry.verified(matched_points(spark, d)), "scale", "turn"), "dx", "dy", digits=5)



def features(spark, d):
    """Documents and the sentences in them, as arrays."""
    cut = F.split(F.regexp_replace("text", r"([.!?])[ \n]+", "$1\n"), "\n")
    return table(spark, d, "documents").select(F.col("doc_id").alias("owner"), F.filter(cut, lambda x: x != "").alias("features"))


_VOTES = """with f as (select distinct owner, feature from (select doc_id as owner, unnest(string_split(regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(10), 'g'), chr(10))) as feature from documents) where feature <> ''),
fs as (select owner, string_agg(feature, chr(10) order by feature) as key, count(*) as size from f group by 1), ff as (select *, min(owner) over (partition by key) as first from fs),
votes as (select x.owner as a, y.owner as b, count(*) as votes from f x join f y using (feature) where x.owner < y.owner and x.owner in (select first from ff) and y.owner in (select first from ff) group by all having count(*) >= 6
  union all select first, owner, size from ff where owner <> first and size >= 6)"""
_CANDIDATES = """, c as (select a, b, votes from (select *, row_number() over (partition by a order by votes desc, b) as of_a, row_number() over (partition by b order by votes desc, a) as of_b from votes where votes >= 6) where of_a <= 30 or of_b <= 30)"""


@query("""select md5(text) as key, count(*) as n, min(doc_id) as first_id, count(distinct source) as sources from documents group by 1""")
def dup_exact(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("sources"))


@query(_VOTES + " select * from votes")
def dup_votes(spark, d):
    return dedup.votes(features(spark, d))


@query(_VOTES + _CANDIDATES + " select * from c")
def dup_candidates_capped(spark, d):
    return dedup.candidates(dedup.votes(features(spark, d), most=dedup.MOST_CANDIDATES))


_COMPONENTS = _VOTES.replace("with f", "with recursive f") + _CANDIDATES + """, v as (select a, b from c join fs x on x.owner = a join fs y on y.owner = b where votes >= 15 and votes::double / least(x.size, y.size) >= 0.5),
e as (select a, b from v union select b, a from v),
reach(owner, x) as (select distinct a, a from e union select r.owner, e.b from reach r join e on r.x = e.a), roots as (select owner, min(x) as root from reach group by 1)"""


@query(_COMPONENTS + " select * from roots")
def dup_components(spark, d):
    rows = dedup.gathered(dedup.sets(features(spark, d)), dedup.LEAST_VOTES)  # owners of fewer features are in no pair
    return dedup.grouped(dedup.verified(dedup.candidates(dedup.counted(rows, most=dedup.MOST_CANDIDATES)), rows))


@query(_COMPONENTS + """, s as (select root, count(*) as n from roots group by 1)
select count(*) as n_groups, ((select count(*) from documents) - coalesce(sum(n), 0))::bigint as n_single, max(n) as largest, quantile_cont(n, 0.5) as median_size from s""")
def dup_group_stats(spark, d):
    return dedup.group_stats(dup_components(spark, d), table(spark, d, "documents").count())


# --- vectors -------------------------------------------------------------------


def as_rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("""with s as (select a.vec_id as id, b.vec_id as other, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 9) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by id order by similarity desc, other) as rank from s),
p as (select id, min(other) filter (rank = 1) as other, min(sqrt(greatest(0.0, 2 - 2 * similarity))) as d1, max(sqrt(greatest(0.0, 2 - 2 * similarity))) as d2 from r where rank <= 2 group by 1)
select id, other, round(d1, 6) as d1, round(d2, 6) as d2, d1 < d2 * 0.8 as kept from p""")
def knn_top2_ratio(spark, d):
    return vectors.ratio_test(vectors.nearest(as_rows(spark, d), 2))


def _unit_sql(v: str) -> str:
    mid = f"list_transform({v}, lambda x: x::double - list_sum({v}::double[]) / 64)"
    return mid, f"list_transform({mid}, lambda x: x / (sqrt(list_inner_product({mid}, {mid})) + 1e-6))"


_UNITS = f"""u as (select vec_id, {_unit_sql("embedding")[1]} as v from embeddings)"""
_ORDERS = symmetries(8)


@query(f"with {_UNITS}, y as (select vec_id, v, k, list_transform(o, lambda i: v[i + 1]) as t from u, (select unnest({_ORDERS!r}) as o, generate_subscripts({_ORDERS!r}, 1) as k)), "
       "s as (select a.vec_id as id, b.vec_id as other, max(round(list_inner_product(a.v, b.t), 9)) as similarity from u a join y b on a.vec_id <> b.vec_id group by 1, 2) "
       "select id, rank::int as rank, other, round(similarity, 6) as similarity from (select *, row_number() over (partition by id order by similarity desc, other) as rank from s) where rank <= 5")
def knn_topk_symmetry(spark, d):
    rows = as_rows(spark, d).withColumn("v", centred_unit(F.col("v").cast("array<double>")))
    return rounded(vectors.nearest(rows, 5, permutations=symmetries(8)), "similarity").withColumn("rank", F.col("rank").cast("int"))


@query(f"""with {_UNITS}, c as (select label, pos, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2),
m as (select label, list(x order by pos) as embedding from c group by 1), w as (select label, {_unit_sql("embedding")[1]} as c from m)
select e.vec_id, round(list_inner_product(u.v, w.c), 6) as pearson from embeddings e join u using (vec_id) join w using (label)""")
def pearson_thumb(spark, d):
    rows = table(spark, d, "embeddings")
    centres = vectors.pool_mean(rows, ["label"], "embedding").select("label", centred_unit(F.col("embedding")).alias("c"))
    return rows.join(centres, "label").select("vec_id", F.round(dot(centred_unit(F.col("embedding").cast("array<double>")), F.col("c")), 6).alias("pearson"))


@query("""select label, list(round(x, 6) order by pos) as embedding from (select label, pos, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2) group by 1""")
def pool_mean(spark, d):
    return vectors.pool_mean(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("embedding", rounded_each(F.col("embedding"), 6))


@query("""select conv_id as bag, count(*) as n_items, string_agg(turn::varchar, ',' order by turn) as turns, max((role = 'system')::int)::int as label from conversations group by 1""")
def bag_build(spark, d):
    rows = table(spark, d, "conversations")
    labels = rows.groupBy("conv_id").agg(F.max((F.col("role") == "system").cast("int")).alias("label"))
    found = vectors.bags(rows.join(labels, "conv_id").select(F.col("conv_id").alias("bag"), "turn", "label"), "bag", "label", "turn")
    return found.select("bag", F.size("rows").cast("long").alias("n_items"), F.array_join("rows", ",").alias("turns"), F.col("label").cast("int").alias("label"))


@query("""select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as at, round(list_max(embedding)::double, 6) as top from embeddings""")
def vector_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("at"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


@query("""select label, round(avg(list_cosine_similarity(embedding[1:32]::double[], embedding[33:64]::double[])), 6) as mean_cosine, round(min(list_cosine_similarity(embedding[1:32]::double[], embedding[33:64]::double[])), 6) as min_cosine from embeddings group by 1""")
def vector_cosine(spark, d):
    near = cosine(F.slice("embedding", F.lit(1), 32), F.slice("embedding", F.lit(33), 32))
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(near), 6).alias("mean_cosine"), F.round(F.min(near), 6).alias("min_cosine"))


@query("""with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
m as (select pos, avg(x) as mean, greatest(stddev_samp(x), 1e-6) as sd from e where vec_id % 5 <> 0 group by 1)
select vec_id, list(round((x - mean) / sd, 5) order by pos) as embedding from e join m using (pos) group by 1""")
def vector_standardize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.standardise(rows, rows.where("vec_id % 5 <> 0"), "embedding").withColumn("embedding", rounded_each(F.col("embedding"), 5))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)) as x from embeddings)
select vec_id, list_transform(x, lambda y: round(y / list_sum(x), 6)) as probs from e""")
def vector_softmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(softmax(F.col("embedding").cast("array<double>")), lambda x: F.round(x, 6)).alias("probs"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: greatest(0.0, x::double)) as v from embeddings), s as (select *, list_sum(v) + 1e-7 as t from e)
select vec_id, list_transform(v, lambda x: round(sqrt(x / t), 6)) as root from s""")
def vector_root(spark, d):
    positive = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(root_normalised(positive), lambda x: F.round(x, 6)).alias("root"))


@query("""select count(*) as n_rows, count(*) - count(distinct embedding::varchar) as repeated, count(*) filter (list_max(list_transform(embedding, lambda x: abs(x))) = 0) as zero_rows,
  count(*) filter (len(list_filter(embedding, lambda x: not isfinite(x))) > 0) as bad_rows, min(len(embedding)) as dims, true as ok from embeddings""")
def feature_health(spark, d):
    rows = table(spark, d, "embeddings")
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("embedding")).alias("repeated"), F.count(F.when(F.forall("embedding", lambda x: x == 0), 1)).alias("zero_rows"), F.count(F.when(bad, 1)).alias("bad_rows"), F.min(F.size("embedding")).cast("long").alias("dims"))
    return out.withColumn("ok", F.expr("repeated = 0 and zero_rows = 0 and bad_rows = 0"))


# --- splits --------------------------------------------------------------------


def indexed(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("grp"), F.col("lang").alias("label"))


_GROUP_SPLIT = """g as (select distinct source as grp from documents), o as (select grp, row_number() over (order by md5('42:' || grp), grp) <= ceil(round(count(*) over () * 0.2, 9)) as test from g),
i as (select grp, row_number() over (order by md5('42:val:' || grp), grp) <= ceil(round(count(*) over () * 0.2, 9)) as val from o where not test),
s as (select d.doc_id as row_id, d.source as grp, d.lang as label, case when test then 'test' when val then 'val' else 'train' end as part from documents d join o on o.grp = d.source left join i on i.grp = d.source)"""


@query("with " + _GROUP_SPLIT + " select * from s")
def split_group(spark, d):
    return splits.split_rows(indexed(spark, d), 42).select("row_id", "grp", "label", "part")


@query("""with a as (select vec_id as row_id, label, row_number() over (partition by label order by md5('42:' || vec_id), vec_id) <= floor(count(*) over (partition by label) * 0.2 + 0.5) as test from embeddings),
b as (select *, row_number() over (partition by label order by md5('42:val:' || row_id), row_id) <= floor(count(*) over (partition by label) * 0.2 + 0.5) as val from a where not test)
select row_id, label, 'test' as part from a where test union all select row_id, label, case when val then 'val' else 'train' end from b""")
def split_stratified(spark, d):
    return splits.split_rows(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.lit("").alias("grp")), 42).select("row_id", "label", "part")


@query("with " + _GROUP_SPLIT + """, m as (select d.doc_id, d.lang, case when d.n_chars < 400 then 'excluded' else s.part end as part from documents d join s on s.row_id = d.doc_id)
select lang, part, count(*) as n from m group by 1, 2""")
def split_manifest(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang", "n_chars")
    parts = splits.split_rows(indexed(spark, d), 42).join(rows.where("n_chars >= 400").select("row_id"), "row_id", "left_semi")
    return splits.manifest(rows, parts).groupBy("lang", "part").agg(F.count("*").alias("n"))


@query("with " + _GROUP_SPLIT + """ select count(*) as leaked from (select distinct grp from s where part = 'test' intersect select distinct grp from s where part <> 'test')""")
def split_leak_check(spark, d):
    return splits.leaks(splits.split_rows(indexed(spark, d), 42)).agg(F.count("*").alias("leaked"))


@query("""select doc_id as row_id from documents order by md5('42:' || doc_id), doc_id limit 500""")
def sample_fixed(spark, d):
    return splits.sample_fixed(table(spark, d, "documents").select(F.col("doc_id").alias("row_id")), 500, 42)


@query("""with n as (select max(doc_id) + 1 as rows from documents), w as (select distinct round_even(i * (rows - 1) / 63.0, 0)::bigint as row_id from n, (select unnest(range(0, 64)) as i))
select doc_id as row_id, lang from documents where doc_id in (select row_id from w)""")
def subset_linspace(spark, d):
    return splits.subset_evenly(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang"), 64)


# --- predictions and metrics -----------------------------------------------------


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """model, dataset, seed, row_id, grp, target, probs: nearest-centroid models of three embedding keys, two data sets, two seeds with a fitting half each."""

    def make() -> DataFrame:
        rows = vectors.variants(table(spark, d, "embeddings").select("vec_id", "label", "embedding"))
        rows = rows.withColumn("seed", F.explode(F.array(F.lit(42), F.lit(43))))
        scored = vectors.centroid_probabilities(rows, ["model", "seed"], fit=hash_int(F.col("seed"), F.col("vec_id")) % 2 == 0)
        scored = scored.select("model", "seed", F.col("vec_id").alias("row_id"), F.col("label").alias("target"), "probs")
        return scored.withColumn("dataset", F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd")).withColumn("grp", (F.col("row_id") % 50).cast("string"))

    return once(spark, d, "predictions", make)


_PRED = """v as (select vec_id, label, m.model, case m.model when 'official' then embedding when 'cls' then embedding[1:32] else embedding[33:64] end as v from embeddings, (select unnest(['official', 'cls', 'patch_mean']) as model) m),
sd as (select unnest([42, 43]) as seed),
cx as (select model, seed, label, pos, avg(x) as x from (select model, seed, label, unnest(v)::double as x, generate_subscripts(v, 1) as pos from v, sd where ('0x' || substr(md5(seed || ':' || vec_id), 1, 8))::bigint % 2 = 0) group by all),
cv as (select model, seed, label, list(x order by pos) as c from cx group by all), cs as (select model, seed, list(c order by label) as centres from cv group by all),
cosines as (select v.model, seed, vec_id, label, list_transform(centres, lambda c: 10.0 * list_cosine_similarity(v.v::double[], c)) as s from v join cs using (model)),
soft as (select model, seed, vec_id, label, list_transform(s, lambda x: exp(x - list_max(s))) as e from cosines),
one as (select model, seed, vec_id as row_id, label as target, list_transform(e, lambda x: round(x / list_sum(e), 6)) as probs from soft),
pred as (select model, row_id, target, probs, case when row_id % 2 = 0 then 'even' else 'odd' end as dataset, (row_id % 50)::varchar as grp, seed, (list_position(probs, list_max(probs)) - 1)::int as pred from one)"""
_SUMS = """lab as (select {k}, label, sum(r) as r, sum(c) as c, sum(h) as h from (select {k}, target as label, w as r, 0 as c, case when target = pred then w else 0 end as h from conf union all select {k}, pred, 0, w, 0 from conf) group by all),
pos as (select *, row_number() over (partition by {k} order by label) - 1 as ix from lab),
tot as (select {k}, sum(h)::double / sum(r) as acc, avg(case when r > 0 then h::double / r end) as bal_acc, sum(coalesce(2.0 * h / nullif(r + c, 0), 0) * r) / sum(r) as f1_weighted, avg(coalesce(2.0 * h / nullif(r + c, 0), 0)) as f1_macro,
  sum(r)::double as n, sum(r)::double * sum(r * ix * ix) - 2.0 * sum(r * ix) * sum(c * ix) + sum(r)::double * sum(c * ix * ix) as ex from pos group by all),
seen as (select {k}, sum(w * (i.ix - j.ix) * (i.ix - j.ix))::double as s from conf join pos i using ({k}) join pos j using ({k}) where i.label = conf.target and j.label = conf.pred group by all),
met as (select {k}, acc, bal_acc, f1_weighted, f1_macro, 1 - s * n / nullif(ex, 0) as qwk from tot join seen using ({k}))"""
_K = "dataset, seed, model"


def _metric_sql(columns: str, weight: str = "1.0") -> str:
    return f"with {_PRED}, conf as (select {_K}, target, pred, sum({weight})::double as w from pred group by all), {_SUMS.format(k=_K)} select {_K}, {columns} from met"


KEYS = ["dataset", "seed", "model"]


@query("with " + _PRED + """, m as (select model, seed, target, avg((pred = target)::int::double) as acc, count(*) as n from pred group by 1, 2, 3) select model, seed, target, round(acc, 6) as acc, n from m""")
def metrics_by_model(spark, d):
    rows = metrics.with_prediction(predictions(spark, d))
    return rows.groupBy("model", "seed", "target").agg(F.round(F.avg((F.col("pred") == F.col("target")).cast("double")), 6).alias("acc"), F.count("*").alias("n"))


@query("with " + _PRED + f" select {_K}, target, pred, count(*)::double as w from pred group by all")
def metric_confusion(spark, d):
    return metrics.confusion(predictions(spark, d), KEYS)


@query(_metric_sql("round(acc, 6) as acc, round(bal_acc, 6) as bal_acc, round(f1_weighted, 6) as f1_weighted, round(f1_macro, 6) as f1_macro"))
def metric_f1(spark, d):
    return rounded(metrics.from_confusion(metrics.confusion(predictions(spark, d), KEYS), KEYS).drop("qwk"), "acc", "bal_acc", "f1_weighted", "f1_macro")


@query(_metric_sql("round(qwk, 6) as qwk"))
def metric_qwk(spark, d):
    return rounded(metrics.from_confusion(metrics.confusion(predictions(spark, d), KEYS), KEYS).select(*KEYS, "qwk"), "qwk")


@query(_metric_sql("round(acc, 6) as acc, round(qwk, 6) as qwk, round(f1_weighted, 6) as f1_weighted", "row_id % 4"))
def metric_weighted(spark, d):
    rows = predictions(spark, d).withColumn("w", (F.col("row_id") % 4).cast("double"))
    return rounded(metrics.from_confusion(metrics.confusion(rows, KEYS, "w"), KEYS).select(*KEYS, "acc", "qwk", "f1_weighted"), "acc", "qwk", "f1_weighted")


@query("""with s as (select lang, quality, least(1.0, round(n_chars / 5000.0, 3))::double as score from labels join documents using (doc_id)),
g as (select lang, score, sum(quality)::double as pos, sum(1 - quality)::double as neg from s group by 1, 2), r as (select *, sum(neg) over (partition by lang order by score) - neg as under from g)
select lang, round(sum(pos * (under + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) as auc from r group by 1""")
def metric_auc_binary(spark, d):
    score = F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000.0, 3))
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", F.col("quality").alias("target"), F.array(1 - score, score).alias("probs"))
    return rounded(metrics.auc_binary(rows, ["lang"]), "auc")


_OVR = f"""ovr as (select {_K}, target, w, unnest(probs) as score, generate_subscripts(probs, 1) - 1 as c from wp),
og as (select {_K}, c, score, sum(case when target = c then w else 0 end)::double as pos, sum(case when target = c then 0 else w end)::double as neg from ovr group by all),
orr as (select *, sum(neg) over (partition by {_K}, c order by score) - neg as under from og),
oa as (select {_K}, c, sum(pos * (under + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc, sum(pos) as pos from orr group by all)
select {_K}, round(case when count(auc) = count(*) then sum(auc * pos) / sum(pos) end, 6) as auc from oa group by all"""


@query("with " + _PRED + ", wp as (select *, 1.0 as w from pred), " + _OVR)
def metric_auc_ovr(spark, d):
    return rounded(metrics.auc_one_vs_rest(predictions(spark, d), KEYS), "auc")


@query("with " + _PRED + f" select {_K}, round(avg(-ln(greatest(probs[target + 1], 1e-12))), 6) as log_loss from pred group by all")
def metric_logloss(spark, d):
    return rounded(metrics.log_loss(predictions(spark, d), KEYS), "log_loss")


# --- resampling and inference ----------------------------------------------------

# draws by splitting down the bits of the groups' hashes, as ``operators.draws`` tells
_DRAWS = f"""gr as (select distinct dataset, seed, grp from pred), gb as (select *, right(('0x' || substr(md5(grp), 1, 12))::bigint::bit::varchar, 48) as bits from gr),
nd as (select dataset, seed, substr(bits, 1, l) as node, count(*) as m, count(*) filter (substr(bits, l + 1, 1) = '0') as ml from gb, (select unnest(range(0, 48)) as l) group by all),
bk as (select m, ml, n, unnest(range(0, n + 1)) as k from (select distinct m, ml from nd where ml > 0 and ml < m), (select unnest(range(0, (select count(*) + 1 from gr))) as n)),
bp as (select m, ml, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(ml::double / m) + (n - k) * ln(1 - ml::double / m)) as p from bk),
bn as materialized (select m, ml, n, list(c order by k) as cdf from (select m, ml, n, k, sum(p) over (partition by m, ml, n order by k) as c from bp) group by all),
tr(dataset, seed, b, node, draws) as (select dataset, seed, b, '', m from nd, (select unnest(range(1, {REPLICATES + 1})) as b) where node = '' union all
  select dataset, seed, b, node || side, case when side = '0' then k else draws - k end from
    (select t.*, nd.m, nd.ml, case when nd.ml = 0 then 0 when nd.ml = nd.m then draws else least(draws, len(list_filter(cdf, lambda x: x < ('0x' || substr(md5(t.dataset || ':' || t.seed || ':' || t.b || ':0:' || t.node), 1, 13))::bigint / 4503599627370496.0))) end as k
     from tr t join nd on nd.dataset = t.dataset and nd.seed = t.seed and nd.node = t.node left join bn on bn.m = nd.m and bn.ml = nd.ml and bn.n = t.draws where nd.m > 1 and t.draws > 0), (select unnest(['0', '1']) as side) where case when side = '0' then ml > 0 else ml < m end),
weights as (select t.dataset, t.seed, b::int as b, grp, draws::double as w from tr t join nd using (dataset, seed, node) join gb on gb.dataset = t.dataset and gb.seed = t.seed and starts_with(gb.bits, t.node) where nd.m = 1 and draws > 0)"""
_KB = "dataset, seed, b, model"
_BOOT = f"{_PRED}, {_DRAWS}, allw as (from weights union all select distinct dataset, seed, 0, grp, 1.0 from pred), conf as (select {_KB}, target, pred, sum(w) as w from pred join allw using (dataset, seed, grp) group by all), {_SUMS.format(k=_KB)}, " + f"""
won as (select p.dataset, p.seed, p.model, p.target as c, p.grp as g, q.grp as h, sum(case when p.probs[p.target + 1] > q.probs[p.target + 1] then 1.0 when p.probs[p.target + 1] = q.probs[p.target + 1] then 0.5 else 0.0 end)::double as u
  from pred p join pred q on p.dataset = q.dataset and p.seed = q.seed and p.model = q.model and p.target <> q.target group by all),
wins as (select won.dataset, won.seed, x.b, model, c, sum(u * x.w * y.w) as wins from won join allw x on won.dataset = x.dataset and won.seed = x.seed and g = x.grp join allw y on won.dataset = y.dataset and won.seed = y.seed and h = y.grp and x.b = y.b group by all),
sides as (select {_KB}, target as c, sum(w) as pos from conf group by all), alls as (select {_KB}, sum(pos) as n from sides group by all),
aucs as (select {_KB}, sum(pos * coalesce(wins, 0) / (pos * (n - pos))) / sum(pos) as auc from sides join alls using ({_KB}) left join wins using ({_KB}, c) group by all),
boot as (select {_KB}, m.metric, case m.metric when 'acc' then acc when 'bal_acc' then bal_acc when 'f1_weighted' then f1_weighted when 'qwk' then qwk else auc end as value from met join aucs using ({_KB}), (select unnest(['acc', 'bal_acc', 'f1_weighted', 'qwk', 'auc']) as metric) m),
sm as (select dataset, b, model, metric, avg(value) as value from boot group by all)"""
_PAIR = """pr as (select x.dataset, x.metric, x.model as model_a, y.model as model_b, x.b, round(x.value - y.value, 9) as d from sm x join sm y on x.dataset = y.dataset and x.b = y.b and x.metric = y.metric and x.model < y.model),
ts as (select dataset, metric, model_a, model_b, max(d) filter (b = 0) as diff, quantile_cont(d, 0.025) filter (b > 0) as ci_low, quantile_cont(d, 0.975) filter (b > 0) as ci_high,
  least(1.0, 2 * least(avg((d <= 0)::int) filter (b > 0), avg((d >= 0)::int) filter (b > 0))) as p from pr group by all),
hs as (select *, least(1.0, (count(*) over (partition by dataset, metric) - row_number() over (partition by dataset, metric order by p, model_a, model_b) + 1) * p) as step from ts),
holm as (select *, max(step) over (partition by dataset, metric order by p, model_a, model_b rows unbounded preceding) as p_holm from hs)"""


def boot(spark, d):
    return once(spark, d, "bootstrap", lambda: inference.bootstrap(predictions(spark, d), REPLICATES))


def pairs(spark, d):
    return inference.pairwise(boot(spark, d))


@query("with recursive " + _PRED + ", " + _DRAWS + " select * from weights")
def boot_weights(spark, d):
    return inference.resamples(inference.effective_groups(predictions(spark, d)), REPLICATES)


@query("with recursive " + _BOOT + " select dataset, seed, b::int as b, model, metric, round(value, 6) as value from boot")
def boot_metrics(spark, d):
    return rounded(boot(spark, d), "value")


@query("with recursive " + _BOOT + """ select dataset, model, metric, round(max(value) filter (b = 0), 6) as mean, round(quantile_cont(value, 0.025) filter (b > 0), 6) as ci_low, round(quantile_cont(value, 0.975) filter (b > 0), 6) as ci_high from sm group by all""")
def boot_ci(spark, d):
    return rounded(inference.intervals(boot(spark, d)), "mean", "ci_low", "ci_high")


@query("with recursive " + _BOOT + ", " + _PAIR + " select dataset, metric, model_a, model_b, round(diff, 6) as diff, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(p, 6) as p, round(p_holm, 6) as p_holm from holm")
def boot_pairwise(spark, d):
    return rounded(pairs(spark, d), "diff", "ci_low", "ci_high", "p", "p_holm")


@query("""with t as (select l_returnflag as family, l_suppkey as test, round(count(*) / 2000.0, 6)::double as p from lineitem group by 1, 2),
s as (select *, least(1.0, (count(*) over (partition by family) - row_number() over (partition by family order by p, test) + 1) * p) as step from t)
select family, test, p, round(max(step) over (partition by family order by p, test rows unbounded preceding), 6) as p_holm from s""")
def holm_adjust(spark, d):
    tests = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("test")).agg(F.round(F.count("*") / 2000.0, 6).alias("p"))
    return rounded(inference.holm(tests, ["family"], ["test"]), "p_holm")


_RANKS = """rk as (select *, rank() over (partition by dataset, seed, b, metric order by round(value, 9) desc) as rank from boot)"""


def ranked_values(spark, d):
    return rounded(boot(spark, d), "value", digits=9)


@query("with recursive " + _BOOT + ", " + _RANKS + " select dataset, seed, b::int as b, model, metric, rank::int as rank from rk")
def rank_min(spark, d):
    return inference.replicate_ranks(ranked_values(spark, d)).select("dataset", "seed", "b", "model", "metric", "rank")


_SHARES = _RANKS + """, rs as (select dataset, metric, model, rank, count(*)::double as n from rk where b > 0 group by all),
sh as (select dataset, metric, model, rank, n / sum(n) over (partition by dataset, metric, model) as share, sum(n * rank) over (partition by dataset, metric, model) / sum(n) over (partition by dataset, metric, model) as mean_rank from rs)"""


@query("with recursive " + _BOOT + ", " + _SHARES + " select dataset, metric, model, rank::int as rank, round(share, 6) as share, round(mean_rank, 6) as mean_rank from sh")
def rank_stability(spark, d):
    return rounded(inference.rank_shares(ranked_values(spark, d)), "share", "mean_rank")


@query("with recursive " + _BOOT + ", " + _SHARES + """, rn as (select *, sum(share) over (partition by dataset, metric, model order by rank rows unbounded preceding) as run from sh)
select dataset, metric, model, round(max(mean_rank), 6) as mean_rank, min(rank) filter (run >= 0.025 - 1e-12)::int as rank_low, min(rank) filter (run >= 0.975 - 1e-12)::int as rank_high from rn group by all""")
def rank_interval(spark, d):
    return rounded(inference.rank_intervals(inference.rank_shares(ranked_values(spark, d))), "mean_rank")


def block_scores(spark, d):
    """dataset, model, value: mean order price of each nation's customers by status, as blocks and treatments of a rank test."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("dataset"), F.col("o_orderstatus").alias("model")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


_SCORES = """sc as (select c_nationkey as dataset, o_orderstatus as model, round(avg(o_totalprice), 2) as value from orders join customer on o_custkey = c_custkey group by 1, 2),
full_ as (select dataset from sc group by 1 having count(distinct model) = (select count(distinct model) from sc)),
ar as (select *, rank() over (partition by dataset order by value desc) + (count(*) over (partition by dataset, value) - 1) / 2.0 as rank, count(*) over (partition by dataset, value) as ties from sc semi join full_ using (dataset))"""


@query("with " + _SCORES + """, m as (select model, sum(rank) as r from ar group by 1), t as (select (select count(distinct dataset) from ar)::double as n, count(*)::double as k, sum(r * r) as squares, (select sum(ties * ties - 1) from ar) as tied from m),
x as (select n, k, (12 / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / (1 - tied / (n * (k * k * k - k))) as statistic from t)
select n::bigint as n, k::bigint as k, round(statistic, 6) as statistic, round(exp(-statistic / 2), 6) as p from x""")
def friedman(spark, d):
    return rounded(inference.friedman(block_scores(spark, d)), "statistic", "p")


_TASK = """{0}_sc as (select * from sc where {1}), {0}_full as (select dataset from {0}_sc group by 1 having count(distinct model) = (select count(distinct model) from sc)),
{0}_ar as (select *, rank() over (partition by dataset order by value desc) + (count(*) over (partition by dataset, value) - 1) / 2.0 as rank, count(*) over (partition by dataset, value) as ties from {0}_sc semi join {0}_full using (dataset)),
{0}_m as (select model, sum(rank) as r from {0}_ar group by 1), {0}_t as (select (select count(distinct dataset) from {0}_ar)::double as n, count(*)::double as k, sum(r * r) as squares, (select sum(ties * ties - 1) from {0}_ar) as tied from {0}_m),
{0}_x as (select '{0}' as task, n, k, (12 / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / (1 - tied / (n * (k * k * k - k))) as statistic from {0}_t)"""


@query("with " + _SCORES + ", " + ", ".join(_TASK.format(t, w) for t, w in (("categorical", "dataset % 3 > 0"), ("ordinal", "dataset % 3 = 0"), ("every", "true"))) + """
select case when task = 'every' then 'all' else task end as task, n::bigint as n, k::bigint as k, round(statistic, 6) as statistic, round(exp(-statistic / 2), 6) as p from (from categorical_x union all from ordinal_x union all from every_x)""")
def friedman_by_task(spark, d):
    """The test over nations with and without ordered classes (every third has), and over all."""
    scores = block_scores(spark, d)
    ordinal = scores.where("dataset % 3 = 0").select("dataset").distinct()
    return rounded(inference.friedman_by_task(scores, ordinal), "statistic", "p")


@query("with " + _SCORES + """, m as (select model, avg(rank) as mean_rank from ar group by 1), t as (select count(*) as k, (select count(distinct dataset) from ar) as n from m)
select model, round(mean_rank, 6) as mean_rank, round([1.960, 2.343, 2.569, 2.728][k - 1] * sqrt(k * (k + 1) / (6.0 * n)), 6) as distance from m, t""")
def nemenyi_cd(spark, d):
    ranked = inference.average_ranks(block_scores(spark, d), ["dataset"])
    k, n = (ranked.select(c).distinct().count() for c in ("model", "dataset"))
    distance = inference.nemenyi_distance(k, n)
    return rounded(ranked.groupBy("model").agg(F.avg("rank").alias("mean_rank")).withColumn("distance", F.lit(distance).cast("double")), "mean_rank", "distance")


@query("""with a as (select l_suppkey as model, round(avg(l_quantity), 3) as value from lineitem where l_returnflag = 'R' group by 1), b as (select l_suppkey as model, round(avg(l_quantity), 3) as value from lineitem where l_returnflag = 'N' group by 1),
ra as (select model, rank() over (order by value desc) + (count(*) over (partition by value) - 1) / 2.0 as a from a), rb as (select model, rank() over (order by value desc) + (count(*) over (partition by value) - 1) / 2.0 as b from b)
select round(corr(a, b), 6) as rho from ra join rb using (model)""")
def spearman(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model"), F.col("l_returnflag").alias("flag")).agg(F.round(F.avg("l_quantity"), 3).alias("value"))
    return rounded(inference.spearman(rows.where("flag = 'R'").select("model", "value"), rows.where("flag = 'N'").select("model", "value")), "rho")


@query("""with m as (select n_name as model, round(avg(c_acctbal), 4) / 100 as mean_rank from customer join nation on c_nationkey = n_nationkey group by 1),
r as (select distinct a.mean_rank as lo, max(b.mean_rank) as hi from m a join m b on b.mean_rank >= a.mean_rank and b.mean_rank <= a.mean_rank + 2.0 group by a.mean_rank having max(b.mean_rank) > a.mean_rank)
select round(lo, 6) as lo, round(hi, 6) as hi from r c where not exists (select 1 from r o where o.lo < c.lo and o.hi >= c.hi)""")
def cd_cliques(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("model"))
    ranks = table(spark, d, "customer").join(nations, "c_nationkey").groupBy("model").agg((F.round(F.avg("c_acctbal"), 4) / 100).alias("mean_rank"))
    return rounded(inference.cliques(ranks, 2.0), "lo", "hi")


# --- selection, probes ------------------------------------------------------------


@query("""with s as (select l_suppkey as model, l_linenumber::double as c_value, round(avg(l_discount), 4) as value from lineitem group by 1, 2)
select model, c_value, value from (select *, row_number() over (partition by model order by value desc, c_value) as n from s) where n = 1""")
def best_c_select(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_linenumber").cast("double").alias("c_value"), "l_discount", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return probe.best_c(sequential_mean(rows, ["model", "c_value"], "l_discount", 4), ["model"])


@query("""with h as (select p_brand as model, (p_partkey // 1) as epoch, round(p_retailprice, 2) as value from part),
t as (select *, max(value) over w as top, max(value) over (partition by model order by epoch rows between unbounded preceding and 1 preceding) as before from h window w as (partition by model order by epoch rows unbounded preceding)),
b as (select *, max(case when value > coalesce(before, '-infinity'::double) then epoch end) over (partition by model order by epoch rows unbounded preceding) as best from t),
f as (select model, min(epoch) filter (epoch - best >= 200) as stop, max(epoch) as last from b group by 1), s as (select b.* from b join f using (model) where epoch <= coalesce(stop, last))
select model, arg_max(best, epoch) as best_epoch, arg_max(top, epoch) as best_value, max(epoch) as last_epoch from s group by 1""")
def early_stop_epoch(spark, d):
    history = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("epoch"), F.round("p_retailprice", 2).alias("value"))
    return probe.best_epoch(history, ["model"], 200)


def probe_items(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = splits.stratified_split(rows.select("row_id", "label"), 42).select("row_id", "part")
    return rows.join(parts, "row_id")


@query()
def probe_logreg(spark, d):
    rows = probe_items(spark, d).withColumn("part", F.when(F.col("part") == "test", "score").otherwise("fit"))
    found = probe.fit_score(rows.withColumn("model", F.lit("official")), ["model"], 0.1)
    return metrics.from_confusion(metrics.confusion(found, ["model"]), ["model"])


@query()
def probe_sweep(spark, d):
    rows = vectors.variants(probe_items(spark, d).withColumnRenamed("v", "embedding"))
    found = probe.sweep(rows, ["model"])
    scores = metrics.auc_one_vs_rest(found, ["model", "c_value"]).withColumnRenamed("auc", "value")
    return probe.best_c(scores, ["model"])


@query("""with recursive e as (select vec_id, label % 2 as y, unnest(embedding[1:8])::double as v, generate_subscripts(embedding[1:8], 1) - 1 as pos from embeddings),
m as (select pos, avg(v) as mean, greatest(stddev_samp(v), 1e-6) as sd from e group by 1), x as (select pos, c, (v - mean) / sd as z, y from e join m using (pos), (select unnest([0.001::double, 0.1::double, 10.0::double]) as c)),
fit(pos, c, it, w, b) as (select distinct pos, c, 0, 0.0::double, 0.0::double from x union all
  select pos, c, it + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) from
    (select pos, c, it, w, b, sum((p - y) * z) + any_value(w) / any_value(c) as gw, sum(p - y) as gb, sum(p * (1 - p) * z * z) + 1 / any_value(c) as hww, sum(p * (1 - p) * z) as hwb, sum(p * (1 - p)) as hbb
     from (select f.*, z, y, 1 / (1 + exp(-(w * z + b))) as p from fit f join x using (pos, c) where it < 15) group by pos, c, it, w, b))
select pos::varchar as model, c as c_value, round(w, 6) as weight, round(b, 6) as bias from fit where it = 15""")
def probe_weights(spark, d):
    """Weight and bias of binary probes on single cells, at their optimum; 24 problems advance in the same passes."""
    cells = table(spark, d, "embeddings").select((F.col("label") % 2).alias("label"), F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "x"))
    rows = cells.select(F.col("pos").cast("string").alias("model"), F.array(F.col("x").cast("double")).alias("v"), "label")
    found = fit_probes(rows, ["model"], [0.001, 0.1, 10.0])
    both = [(u[0], c, float(w[0, 1] - w[0, 0]), float(w[1, 1] - w[1, 0])) for u, p in found.items() for c, w in p.weights.items()]
    return rounded(spark.createDataFrame(both, "model string, c_value double, weight double, bias double"), "weight", "bias")


@query()
def external_eval(spark, d):
    """Fit on even rows, applied unchanged to odd ones."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("part", F.when(F.col("row_id") % 2 == 0, "fit").otherwise("score")).withColumn("model", F.lit("official"))
    found = probe.fit_score(rows, ["model"], 0.1)
    return metrics.auc_one_vs_rest(found, ["model"]).join(metrics.from_confusion(metrics.confusion(found, ["model"]), ["model"]), "model")


def bag_rows(spark, d):
    """Bags of ten vectors of one label each; a fifth is test, a fifth val."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = rows.withColumn("bag", F.col("label").cast("long") * 1_000_000 + F.floor(place / 10))
    bags = rows.groupBy("bag", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("items"))
    fifth = hash_int("bag", F.col("bag")) % 5
    return bags.withColumn("part", F.when(fifth == 0, "test").when(fifth == 1, "val").otherwise("train")).withColumn("model", F.lit("official"))


@query()
def abmil_slide(spark, d):
    """Test predictions of gated attention over bags, by the best of a few epochs."""
    settings = attention.Settings(hidden=32, attention=16, epochs=6, patience=3, rate=1e-2, batch=64)
    return attention.train(bag_rows(spark, d), ["model"], settings)[1]


# --- reports -----------------------------------------------------------------------


def quantised_sets(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = F.col("v")
    kinds = [("int8", quantised(v, 8)), ("int4", quantised(v, 4)), ("fp16", floating(v, 11, -14, 65504.0)), ("bf16", floating(v, 8, -126, 3.3895313892515355e38)), ("fp32", v)]
    rows = rows.select("row_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds))).alias("x")).select("row_id", "x.kind", "x.v")
    return rows.withColumn("pred", argmax(F.transform("v", lambda x: F.round(x, 6))))


_QUANT = """s as (select vec_id as row_id, embedding::double[] as v, list_max(list_transform(embedding, lambda x: abs(x::double))) as top from embeddings),
i as (select row_id, v, k.kind, list_transform(v, lambda x: round_even(x / (top / k.levels), 0) * (top / k.levels)) as z from s, (select unnest(['int8', 'int4']) as kind, unnest([127.0, 7.0]::double[]) as levels) k),
f as (select row_id, v, k.kind, list_transform(v, lambda x: case when x = 0 then 0.0 else round_even(x / pow(2.0, greatest(floor(log2(abs(x))), k.least) - k.digits + 1), 0) * pow(2.0, greatest(floor(log2(abs(x))), k.least) - k.digits + 1) end) as z
  from s, (select unnest(['fp16', 'bf16']) as kind, unnest([11.0, 8.0]::double[]) as digits, unnest([-14.0, -126.0]::double[]) as least) k),
q as (from i union all from f),
p as (select *, list_position(list_transform(z, lambda x: round(x, 6)), list_max(list_transform(z, lambda x: round(x, 6)))) as pa, list_position(list_transform(v, lambda x: round(x, 6)), list_max(list_transform(v, lambda x: round(x, 6)))) as pb from q)"""


@query("with " + _QUANT + " select kind, round(avg((pa = pb)::int), 6) as agreement, round(avg(list_cosine_similarity(z, v)), 6) as mean_cosine, round(min(list_cosine_similarity(z, v)), 6) as min_cosine from p group by 1")
def precision_agreement(spark, d):
    sets = quantised_sets(spark, d)
    exact = sets.where("kind = 'fp32'").drop("kind")
    every = exact.withColumn("kind", F.explode(F.array(*map(F.lit, ("int8", "int4", "fp16", "bf16")))))
    return rounded(report.agreement(sets.where("kind <> 'fp32'"), every, ["kind"]), "agreement", "mean_cosine", "min_cosine")


@query("""select event_type as kind, user_id % 5 as model, round(avg(value), 6) as ms, round(stddev_samp(value), 6) as ms_sd, round(avg(1000.0 / nullif(value, 0)), 4) as per_second, round(stddev_samp(1000.0 / nullif(value, 0)), 3) as per_second_sd, count(*) as n from events group by 1, 2""")
def precision_summary(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("model"), F.col("value").alias("ms"))
    out = report.timing(rows, ["kind", "model"])
    return rounded(rounded(rounded(out, "ms", "ms_sd"), "per_second", digits=4), "per_second_sd", digits=3)


@query("""with m as (select event_type as kind, user_id % 5 as model, avg(value) as ms from events group by 1, 2), b as (select model, ms as base from m where kind = 'purchase')
select model, kind, round(base / ms, 6) as ratio from m join b using (model) where kind <> 'purchase'""")
def speedup(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 5).alias("model")).agg(F.avg("value").alias("ms"))
    return rounded(report.speed_up(rows, "purchase"), "ratio")


_OFFICIAL = """op as (select dataset, seed, b, model, metric, case when dataset = 'odd' and b = 0 then max(case when seed = 42 then value end) over (partition by dataset, b, model, metric) else value end as value from boot),
os as (select * from op where dataset <> 'odd' or seed = 42), om as (select dataset, b, model, metric, avg(value) as value from os group by all)"""


def official_values(spark, d):
    """Replicates in which the seeds of one dataset have the same point estimates, as those of an official partition."""
    values = boot(spark, d)
    first = values.where("dataset = 'odd' and seed = 42 and b = 0").select("dataset", "b", "model", "metric", F.col("value").alias("first"))
    joined = values.join(first, ["dataset", "b", "model", "metric"], "left")
    return joined.withColumn("value", F.when((F.col("dataset") == "odd") & (F.col("b") == 0), F.col("first")).otherwise(F.col("value"))).select(values.columns)


@query("with recursive " + _BOOT + ", " + _OFFICIAL + """ select dataset, model, metric, round(max(value) filter (b = 0), 6) as mean, round(quantile_cont(value, 0.025) filter (b > 0), 6) as ci_low, round(quantile_cont(value, 0.975) filter (b > 0), 6) as ci_high from om group by all""")
def official_ci(spark, d):
    """Intervals of one seed where all seeds agree, over seeds elsewhere."""
    return rounded(inference.intervals(inference.official(official_values(spark, d))), "mean", "ci_low", "ci_high")


@query("with recursive " + _BOOT + ", " + _OFFICIAL + ", " + _PAIR.replace("from sm x join sm y", "from om x join om y") + " select dataset, metric, model_a, model_b, round(diff, 6) as diff, round(p, 6) as p, round(p_holm, 6) as p_holm from holm")
def official_pairwise(spark, d):
    return rounded(inference.pairwise(inference.official(official_values(spark, d))).select("dataset", "metric", "model_a", "model_b", "diff", "p", "p_holm"), "diff", "p", "p_holm")


_MAIN = """mn as (select dataset, model, round(max(value) filter (b = 0), 9) as mean from sm where metric = 'acc' group by all),
ci as (select dataset, model, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from sm where metric = 'acc' and b > 0 group by all),
rk as (select *, row_number() over (partition by dataset order by mean desc, model) as place from mn), be as (select dataset, model as best from rk where place = 1),
jt as (select rk.dataset, rk.model, rk.mean, best, h.p_holm from rk join be using (dataset) left join holm h on h.dataset = rk.dataset and h.metric = 'acc' and ((h.model_a = best and h.model_b = rk.model) or (h.model_b = best and h.model_a = rk.model))),
nt as (select *, sum((model <> best and (p_holm is null or p_holm >= 0.05))::int) over (partition by dataset) as tied from jt),
su as (select dataset, model, avg(value) as mean, stddev_samp(value) as sd from boot where b = 0 and metric = 'acc' group by all),
ce as (select nt.dataset, nt.model, case when nt.model = best and tied = 0 then '**' when nt.model = best or p_holm is null or p_holm >= 0.05 then '_' else '' end as sign,
  printf('%.4f', round(su.mean, 6)) || '±' || case when round(sd, 6) > 0 and round(sd, 6) < 0.0001 then '<0.0001' else printf('%.4f', round(sd, 6)) end || ' [' || printf('%.4f', round(lo, 6)) || ', ' || printf('%.4f', round(hi, 6)) || ']' as cell from nt join ci using (dataset, model) join su using (dataset, model))"""


@query("with recursive " + _BOOT + ", " + _PAIR + ", " + _MAIN + """ select model, max(sign || cell || sign) filter (dataset = 'even') as even, max(sign || cell || sign) filter (dataset = 'odd') as odd from ce group by 1""")
def report_cells(spark, d):
    """The main table as it is shown: a row for each model, cells with mean, deviation, interval and mark."""
    values = boot(spark, d)
    ci = inference.intervals(values).where("metric = 'acc'")
    tests = inference.pairwise(values).where("metric = 'acc'").select("dataset", "model_a", "model_b", F.col("p_holm").alias("p"))
    marked = inference.marks(rounded(ci.select("dataset", "model", "mean"), "mean", digits=9), tests)
    summary = rounded(report.seed_summary(values.where("b = 0 and metric = 'acc'")), "mean", "sd")
    return report.main_table(summary, rounded(ci, "ci_low", "ci_high"), marked, ["even", "odd"])


@query("with recursive " + _BOOT + ", " + _PAIR + """, mn as (select dataset, model, round(max(value) filter (b = 0), 9) as mean from sm where metric = 'acc' group by all),
ci as (select dataset, model, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from sm where metric = 'acc' and b > 0 group by all),
rk as (select *, row_number() over (partition by dataset order by mean desc, model) as place from mn), be as (select dataset, model as best from rk where place = 1),
jt as (select rk.dataset, rk.model, rk.mean, best, h.p_holm from rk join be using (dataset) left join holm h on h.dataset = rk.dataset and h.metric = 'acc' and ((h.model_a = best and h.model_b = rk.model) or (h.model_b = best and h.model_a = rk.model))),
nt as (select *, sum((model <> best and (p_holm is null or p_holm >= 0.05))::int) over (partition by dataset) as tied from jt)
select nt.dataset, nt.model, round(mean, 6) as mean, round(lo, 6) as ci_low, round(hi, 6) as ci_high, case when model = best and tied = 0 then 'bold' when model = best or p_holm is null or p_holm >= 0.05 then 'under' else '' end as mark from nt join ci using (dataset, model)""")
def report_main(spark, d):
    values = boot(spark, d)
    ci = inference.intervals(values).where("metric = 'acc'")
    tests = inference.pairwise(values).where("metric = 'acc'").select("dataset", "model_a", "model_b", F.col("p_holm").alias("p"))
    marked = inference.marks(rounded(ci.select("dataset", "model", "mean"), "mean", digits=9), tests)
    return rounded(marked.select("dataset", "model", "mean", "mark").join(ci.select("dataset", "model", "ci_low", "ci_high"), ["dataset", "model"]), "mean", "ci_low", "ci_high")


@query("with recursive " + _BOOT + ", " + _PAIR + """ select dataset, model_a, model_b, round(p_holm, 6) as p_holm, p_holm < 0.05 as differs from holm where metric = 'qwk'""")
def report_marks(spark, d):
    tests = pairs(spark, d).where("metric = 'qwk'").select("dataset", "model_a", "model_b", "p_holm")
    return rounded(tests.withColumn("differs", F.col("p_holm") < 0.05), "p_holm")


@query("with recursive " + _BOOT + """, w as (select dataset, model, max(value) filter (metric = 'acc') as acc, max(value) filter (metric = 'bal_acc') as bal_acc, max(value) filter (metric = 'f1_weighted') as f1_weighted, max(value) filter (metric = 'qwk') as qwk, max(value) filter (metric = 'auc') as auc from sm where b = 0 group by all)
select dataset, model, round(acc, 6) as acc, round(bal_acc, 6) as bal_acc, round(f1_weighted, 6) as f1_weighted, round(qwk, 6) as qwk, round(auc, 6) as auc from w""")
def report_secondary(spark, d):
    summary = report.seed_summary(boot(spark, d).where("b = 0"))
    return rounded(report.wide(summary, ["dataset", "model"], "metric", "mean", list(inference.METRICS)), *inference.METRICS)


@query("with recursive " + _BOOT + """, w as (select dataset, metric, max(value) filter (model = 'official') as official, max(value) filter (model = 'cls') as cls, max(value) filter (model = 'patch_mean') as patch_mean from sm where b = 0 group by all)
select dataset, metric, round(official, 6) as official, round(cls, 6) as cls, round(patch_mean, 6) as patch_mean, abs(official - cls) <= 1e-6 as same from w""")
def report_sensitivity(spark, d):
    summary = report.seed_summary(boot(spark, d).where("b = 0"))
    out = report.wide(summary, ["dataset", "metric"], "model", "mean", ["official", "cls", "patch_mean"])
    return rounded(out.withColumn("same", F.abs(F.col("official") - F.col("cls")) <= 1e-6), "official", "cls", "patch_mean")


@query("with " + _PRED + """, s as (select row_id, grp, target from pred where model = 'official' and seed = 42),
a as (select * from (select *, row_number() over (partition by target, grp order by md5('42:' || row_id), row_id) as n from s) where n = 1)
select row_id, grp, target from (select *, row_number() over (partition by target order by md5('42:' || grp), grp) as m from a) where m <= 4""")
def report_qualitative(spark, d):
    return report.qualitative(predictions(spark, d).where("model = 'official' and seed = 42").select("row_id", "grp", "target"), 4, 42)


@query("with recursive " + _BOOT + """, h as (select dataset, metric, count(*) as n from sm where b = 0 and value >= 0.999 group by 1, 2 having count(*) >= 2),
f as (select dataset, model, max(spread) as spread from (select dataset, model, metric, max(value) - min(value) as spread from boot where b = 0 group by all) group by all)
select dataset, 'ceiling' as kind, metric as subject from h union all select dataset, 'identical seeds', model from f where spread <= 1e-12""")
def report_warnings(spark, d):
    runs = boot(spark, d).where("b = 0")
    return report.warnings(report.seed_summary(runs), runs)


@query("with recursive " + _BOOT + """, w as (select dataset, model, metric, avg(value) as mean, coalesce(stddev_samp(value), 0) as sd, count(*) as n_seeds from boot where b = 0 group by all)
select dataset, model, metric, round(mean, 6) as mean, round(sd, 6) as sd, n_seeds from w""")
def seed_summary(spark, d):
    return rounded(report.seed_summary(boot(spark, d).where("b = 0")), "mean", "sd")


@query("with " + _PRED + """, m as (select dataset, seed, count(distinct model) as models from pred group by all), i as (select dataset, seed, row_id, count(distinct model) as m, count(*) as n, count(distinct target) as t from pred group by all)
select dataset, seed, count(*) as items, max(models) as models, bool_and(m = models and n = m and t = 1) as ok from i join m using (dataset, seed) group by all""")
def predictions_aligned(spark, d):
    return metrics.aligned(predictions(spark, d))


@query("""with c as (select source, lang, count(*)::double as n from documents group by 1, 2) select source, round(max(n) / sum(n), 6) as share from c group by 1""")
def majority_share(spark, d):
    return rounded(report.majority_share(table(spark, d, "documents"), ["source"], "lang"), "share")


@query("""with e as (select user_id as dataset, event_type as kind, avg(value) as v from events group by 1, 2), f as (select dataset from e group by 1 having count(*) = (select count(distinct kind) from e))
select kind, round(avg(v), 6) as mean, round(min(v), 6) as low, count(*) as n from e semi join f using (dataset) group by 1""")
def precision_complete(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("dataset"), F.col("event_type").alias("kind")).agg(F.avg("value").alias("v"))
    return rounded(report.complete(rows, "dataset", "kind").groupBy("kind").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.count("*").alias("n")), "mean", "low")


@query("""with n as (select distinct p_brand as model from part), o as (select model, row_number() over (order by case model when 'Brand#33' then 0 when 'Brand#11' then 1 else 2 end, model) - 1 as place from n)
select p_partkey, p_brand as model, place::int as place from part join o on model = p_brand""")
def display_order(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model"))
    return report.ordered(rows, ["Brand#33", "Brand#11"]).select("p_partkey", "model", "place")


@query("with recursive " + _BOOT + """, p as (select * from boot where b = 0), s as (select dataset, max(spread) <= 1e-12 as same from (select dataset, model, metric, max(value) - min(value) as spread from p group by all) group by 1),
f as (select dataset, min(seed) as first from p group by 1) select dataset, seed, model, metric, round(value, 6) as value from p join s using (dataset) join f using (dataset) where not same or seed = first""")
def official_single_seed(spark, d):
    return rounded(report.single_seed(boot(spark, d).where("b = 0")).select("dataset", "seed", "model", "metric", "value"), "value")


@query("with recursive " + _BOOT + """, e as (select model, metric, value from sm where b = 0 and dataset = 'even'), o as (select model, metric, value from sm where b = 0 and dataset = 'odd' and metric <> 'qwk')
select model, metric, round(e.value, 6) as internal, round(o.value, 6) as external, round(e.value - o.value, 6) as difference from e full join o using (model, metric)""")
def report_external(spark, d):
    values = inference.over_seeds(boot(spark, d)).where("b = 0")
    out = report.side_by_side(values.where("dataset = 'even'"), values.where("dataset = 'odd' and metric <> 'qwk'"), ["model", "metric"], ("internal", "external"))
    return rounded(out, "internal", "external", "difference")


@query("with recursive " + _BOOT + """ select metric, round(min(value), 6) as low, round(max(value), 6) as high from sm where b = 0 group by 1""")
def report_macros(spark, d):
    values = inference.over_seeds(boot(spark, d)).where("b = 0")
    return rounded(values.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high")), "low", "high")


@query("""select label % 4 as label, count(*) as n from embeddings group by 1""")
def stream_shards(spark, d):
    """Embeddings ingested shard by shard through a file stream, then counted."""
    import uuid

    from .streaming import shards

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("label"), "embedding")
    rows.repartitionByRange(4, "vec_id").write.parquet(f"{base}/source")
    shards.ingest(spark, f"{base}/source", rows.schema, f"{base}/target", f"{base}/log")
    return shards.sizes(spark, f"{base}/target", "label", "embedding").select("label", "n")


from . import catalog_stores  # noqa: E402, F401  registers its queries
