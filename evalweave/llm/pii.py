r"""Personal data by bootstrapped contextual extraction (operator 12), in DataFrame functions alone.

Seeds are the entities of four base patterns (email, ip, card, phone).  The two
words before an entity are its lexical pattern.  Patterns and the values that they
are seen with make a graph.  A pattern's confidence for a kind is the share of that
kind among all that follows it: distinct base values count 1, distinct unknown
identifiers count their own confidence, and distinct plain words, counted over
all texts, count 0.  An unknown identifier's confidence is that not all of its
patterns are wrong.  Both are computed by turns, ``ROUNDS`` times.  Patterns need
``SUPPORT`` distinct base values of the kind and a confidence of ``PATTERN``.
Unknown identifiers of confidence ``ACCEPTED`` after such a pattern are added as
spans of its kind, unless they overlap a base span; base spans all stay.

An unknown identifier is a run of at most 64 of ``A-Za-z0-9@._%+-`` with an ``@``
(for email) or at least four digits and no ``@`` (for the other kinds); marks at its
ends don't belong to it.  Words of contexts are lower-cased, digits count as 0 and
quotes, brackets and the like as nothing; ``:`` and ``=`` are words.

Base matches are leftmost and do not overlap within a kind; those that fail their
check are dropped.  The regular expressions here are the plain ones, made linear:
groups are possessive where nothing could be given back, and a match begins at the
start of a run or where the last match ended.

Positions are code points, and come from running sums of the lengths between
matches.  Each row of documents is on its own, whatever its id: null ids and rows
of one id are scanned like any other.  Null and empty texts have no spans.  Texts of
any length are read whole.  Contexts and values are known by 64-bit hashes.  Extra
columns play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

KINDS = ["email", "ip", "card", "phone"]
#: Unknown identifiers.
OTHER = len(KINDS)
SUPPORT, PATTERN, ACCEPTED, ROUNDS = 3, 0.5, 0.6, 4
SALT = 16
#: One in so many texts is read to turn down contexts that plain words follow too often.
FIRST_TEXTS = 64
#: Characters before an entity that its context is taken from.
BEFORE = 100
LONGEST = 64

_RUN = "A-Za-z0-9@._%+-"
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?:(?<![{_RUN}])|\G)[A-Za-z._%+-]*+[0-9@][{_RUN}]*+",
]
#: What a text must have for a pattern to be tried.
NEEDED = ["@", ".", "", "+", ""]
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Characters that contexts leave out.
DROPPED = "\"'`()[]{}<>.,;!?*&%$#"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a short text have a Luhn sum that ends in 0."""
    figures = F.reverse(F.split(digits(value), ""))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def holds(kind: int, value: Column) -> Column:
    """Whether a match of a pattern passes its check."""
    n = F.length(digits(value))
    checks = [F.lit(True), value.rlike(IP), F.when(n.between(14, 19), luhn(value)).otherwise(False), n.between(10, 15)]
    return [*checks, (F.length(value) <= LONGEST) & (value.contains("@") | (n >= 4))][kind]


def plain(text: Column) -> Column:
    """A text as contexts see it: words in lower case between white space."""
    return F.regexp_replace(F.translate(F.lower(text), "0123456789" + DROPPED, "0" * 10), "([:=])", " $1 ")


def context(gap: Column) -> Column:
    """Hash of the last two words of the text before an entity; null where there are fewer."""
    tail = F.when(F.length(gap) <= BEFORE, F.concat(F.lit(" "), gap)).otherwise(F.right(gap, F.lit(BEFORE)))
    two = F.split(F.regexp_extract(plain(tail), r"\s(\S+\s+\S+)\s+$", 1), r"\s+")
    return F.when(F.size(two) == 2, F.xxhash64(two[0], two[1]))


def mentions(text: Column, kind: int) -> Column:
    """All matches of a pattern in order: what lies before each, and what it is."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), matches.alias("match"))

    def one(x: Column, i: Column) -> Column:
        lead = F.length(F.regexp_extract(x["match"], "^[._%-]*+", 0)) if kind == OTHER else F.lit(0)
        trail = F.length(F.regexp_extract(x["match"], "(?<![._%+-])[._%+-]++$", 0)) if kind == OTHER else F.lit(0)
        ok = holds(kind, x["match"])
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("len"),
            F.when(ok, lead).alias("lead"), F.when(ok, trail).alias("trail"), ok.alias("ok"),
            F.when(ok, F.xxhash64(F.lower(x["match"]))).alias("value"), F.when(ok, context(x["gap"])).alias("context"),
            (F.when(ok, x["match"].contains("@")) if kind == OTHER else F.lit(None).cast("boolean")).alias("mail"),
        )

    found = F.transform(F.filter(pairs, lambda x: x["match"].isNotNull()), one)
    wanted = text.contains(NEEDED[kind]) if NEEDED[kind] else text.rlike("[0-9@]" if kind == OTHER else "[0-9]")
    return F.when(wanted, found)


def placed(found: DataFrame) -> DataFrame:
    """row, kind, start, end, value, context, mail of the matches that pass, unknown identifiers only where no base span is."""
    one = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    one = one.withColumn("stop", end).where("ok").withColumn("start", F.col("stop") - F.col("len") + F.col("lead")).withColumn("end", F.col("stop") - F.col("trail"))
    base = F.col("kind") < OTHER
    # of equal starts the base spans come first, so each row's base spans lie before it or at a later start
    order = W.partitionBy("row").orderBy("start", "kind", "end")
    one = one.withColumn("reached", F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = one.withColumn("next", F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing)))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")) & (F.col("start") < F.col("end"))
    return one.where(base | free).select("row", "kind", "start", "end", "value", "context", "mail")


def suits(kind: Column) -> Column:
    """Whether an unknown identifier has the shape of a kind."""
    return F.col("mail") == (kind == KINDS.index("email"))


def salted(patterns: DataFrame) -> DataFrame:
    """A row for each salt, as a common pattern may have a third of all edges."""
    return patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def graph(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns with enough support (context, kind), and all edges of theirs (context, kind, value, mail, salt)."""
    edges = spans.where("context is not null").select("context", "kind", "value", "mail").distinct().withColumn("salt", F.pmod("value", F.lit(SALT)).cast("int"))
    edges = written(edges, "pii-edges")
    patterns = edges.where(F.col("kind") < OTHER).groupBy("context", "kind").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    patterns = written(patterns, "pii-patterns")
    contexts = salted(patterns.select("context").distinct())
    return patterns, edges.join(contexts, ["context", "salt"], "left_semi")


def plain_followers(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, plain: the number of distinct plain words that follow each context in all texts."""
    cut = texts.select(F.split(F.trim(F.regexp_replace(plain(F.col("text")), r"\s+", " ")), " ").alias("w"))
    n = F.size("w") - 2
    cut = cut.where(n > 0).select(F.explode(F.arrays_zip(F.slice("w", 1, n).alias("a"), F.slice("w", 2, n).alias("b"), F.slice("w", 3, n).alias("c"))).alias("x"))
    follow = cut.select(F.xxhash64("x.a", "x.b").alias("context"), F.col("x.c").alias("word")).where(~F.col("word").contains("0") & ~F.col("word").contains("@"))
    # Spark sends the contexts to all tasks only where they are few; else both sides go by salted context
    # one more context, which no words have: all texts are read at every size, not only where patterns happen to be left
    contexts = contexts.unionByName(texts.sparkSession.range(1).select(F.lit(0).cast("long").alias("context")))
    follow = follow.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALT)).cast("int")).join(salted(contexts), ["context", "salt"], "left_semi")
    return written(follow.select("context", F.xxhash64("word").alias("word")).distinct().groupBy("context").agg(F.count("*").alias("plain")), "pii-followers")


def possible(patterns: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Patterns that can still reach ``PATTERN``, though nothing but plain words of one text in ``FIRST_TEXTS`` is counted.

    Plain words of all texts are no fewer, so nothing is lost; common pairs of words go
    before all texts are read.
    """
    first = plain_followers(texts.where(F.pmod(F.xxhash64("text"), F.lit(FIRST_TEXTS)) == 0), patterns.select("context").distinct())
    known = edges.groupBy("context").agg(F.countDistinct("value", "kind").alias("n"))
    worse = first.join(known, "context").where(F.col("n") < PATTERN * (F.col("n") + F.col("plain"))).select("context")
    return written(patterns.join(worse, "context", "left_anti"), "pii-possible")


def confident(patterns: DataFrame, edges: DataFrame, followers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (context, kind, confidence) and of unknown identifiers (value, kind, confidence) after ``ROUNDS`` turns."""
    known = edges.groupBy("context").agg(F.countDistinct("value", "kind").alias("n"))
    patterns = patterns.join(known, "context").join(followers, "context", "left")
    patterns = written(patterns.select("context", "kind", "support", (F.col("n") + F.coalesce("plain", F.lit(0))).alias("all")), "pii-counted")
    unknown = edges.where(F.col("kind") == OTHER).drop("kind")
    gained = None
    for k in range(ROUNDS):
        now = patterns if gained is None else patterns.join(gained, ["context", "kind"], "left")
        sure = F.col("support") if gained is None else F.col("support") + F.coalesce("gain", F.lit(0.0))
        now = now.select("context", "kind", F.round(sure / F.col("all"), 9).alias("confidence")).where(F.col("confidence") >= PATTERN)
        now = written(now, f"pii-round-{k}")
        pairs = unknown.join(salted(now), ["context", "salt"]).where(suits(F.col("kind")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        values = written(pairs.groupBy("value", "kind").agg(F.round(1 - doubt, 9).alias("confidence")), f"pii-values-{k}")
        gained = pairs.drop("confidence").join(values, ["value", "kind"]).groupBy("context", "kind").agg(F.sum("confidence").alias("gain"))
    return now, values


def spans_of(docs: DataFrame) -> DataFrame:
    """row, doc_id and spans (start, kind, end, base) in order, of each row of ``docs`` (doc_id, text)."""
    given = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    kinds = [F.coalesce(mentions(F.col("text"), k), F.array().cast(_MENTIONS)) for k in range(OTHER + 1)]
    # row numbers hold once they are written
    found = written(given.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*kinds).alias("mentions")), "pii-mentions")
    spans = written(placed(found), "pii-spans")
    patterns, edges = graph(spans)
    base = spans.where(F.col("kind") < OTHER).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    if not patterns.isEmpty():
        edges = written(edges, "pii-kept-edges")
        patterns = possible(patterns, edges, given)
        followers = plain_followers(given, patterns.select("context").distinct())
        sure, values = confident(patterns, edges, followers)
        values = values.where(F.col("confidence") >= ACCEPTED).select("value", "kind")
        unknown = spans.where((F.col("kind") == OTHER) & F.col("context").isNotNull()).drop("kind").withColumn("salt", F.pmod("value", F.lit(SALT)).cast("int"))
        added = unknown.join(salted(sure), ["context", "salt"]).where(suits(F.col("kind"))).join(values, ["value", "kind"])
        best = F.min(F.struct((-F.col("confidence")).alias("minus"), "kind"))["kind"]
        added = added.groupBy("row", "start", "end").agg(best.alias("kind")).select("row", "kind", "start", "end", F.lit(False).alias("base"))
        base = base.unionByName(added)
    listed = base.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    return found.select("row", "doc_id").join(listed, "row", "left")


_MENTIONS = "array<struct<kind:int,at:int,gap:int,len:int,lead:int,trail:int,ok:boolean,value:bigint,context:bigint,mail:boolean>>"


def written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(table(spark, sf_dir, "documents")).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
