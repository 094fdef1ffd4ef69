"""Operator 4, URL filters by a character language-model ratio. DataFrame functions only.

Two variable-order Markov models, of accepted and of rejected URLs, are counted
over every URL that a rule decides: n-grams of 1 to ORDER characters, smoothed
by Witten-Bell interpolation with the next shorter context, down to a uniform
distribution. A URL without a rule gets the difference of the two
log-likelihoods by its length, at the longest contexts that the models know.
The cut is calibrated on the rule-decided URLs of one hash fold, left out of
the counts of the model it is judged with: the value that separates the folds'
two classes with the least weighted error.

URLs are first reduced to distinct strings with counts (all that follows the
scheme, the host in small letters, runs of digits alike), so a hot host costs one
row from there on. A string is split into its characters once, so the cost grows
with its length. The model's size is bounded by the characters' n-grams; it is
joined by hash, as a broadcast only while its measured row count stays under
MODEL_ROWS and by a shuffle beyond. Ratios are summed in steps of 1 / SCALE, as
whole numbers, so that no order of summing changes a verdict at the cut.

Defined results: a null url or one without `://` has an empty host and path,
no rule, and is judged as the empty string, whose ratio is 0; without rules or
without either class the cut is 0; a ratio that equals the cut is allowed; repeated
rows are each judged; urls of any length are read whole; an empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: (host suffix, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 4
MODEL_ROWS = 500_000
START = "\x02"
SCALE = 1_000_000_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path after the first `://`; A-Z of the host lower-cased."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    # (?s): a url may hold line ends
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = at > 0
    return F.when(has, low).otherwise(""), F.when(has, path).otherwise("")


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and starts the path, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the last to fit is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, v).otherwise(verdict)
    return name, verdict


def normal(url: Column, host: Column) -> Column:
    """What the models read: the host and all that follows it, with every run of digits as one 0; empty for no url."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3 + F.length(host), F.length(url))
    return F.when(at > 0, F.regexp_replace(F.concat(host, rest), "[0-9]+", "0")).otherwise("")


def _positions(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each character: c, and the ORDER - 1 before it as `seen` (shorter at the start)."""
    split = df.where(F.length(text) > 0).select(*keep, F.split(F.concat(F.lit(START), F.col(text)), "").alias("_c"))
    seen = lambda i: F.array_join(F.slice("_c", F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i - 1, F.lit(ORDER - 1))), "")
    each = F.transform(F.sequence(F.lit(2), F.size("_c")), lambda i: F.struct(F.get("_c", i - 1).alias("c"), seen(i).alias("seen")))
    return split.select(*keep, F.explode(each).alias("_x")).select(*keep, "_x.c", "_x.seen")


def train(urls: DataFrame) -> DataFrame:
    """urls(text, weight, good) -> model(ctx, c, a, r): smoothed probabilities of both classes for every n-gram seen in either, and (ctx, null, a, r): what is left for others."""
    rows = _positions(urls, "text", "weight", "good")
    gram = rows.select("weight", "good", "c", F.explode(F.transform(F.sequence(F.lit(0), F.length("seen")), lambda k: F.substring(F.col("seen"), F.length("seen") - k + 1, k))).alias("ctx"))
    n = written(gram.groupBy("ctx", "c").agg(F.sum(F.when(F.col("good"), F.col("weight")).otherwise(0)).alias("na"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("weight"))).alias("nr")), "grams")
    total = n.groupBy("ctx").agg(*(f for k in "ar" for f in (F.sum(f"n{k}").alias(f"s{k}"), F.sum((F.col(f"n{k}") > 0).cast("int")).alias(f"t{k}"))))
    # what a context leaves to the shorter one: all, where its class never had it
    left = written(total.select("ctx", "sa", "sr", *(F.when(F.col(f"s{k}") > 0, F.col(f"t{k}") / (F.col(f"s{k}") + F.col(f"t{k}"))).otherwise(1.0).alias(f"l{k}") for k in "ar"), *(F.when(F.col(f"s{k}") > 0, 1 / (F.col(f"s{k}") + F.col(f"t{k}"))).otherwise(0.0).alias(f"u{k}") for k in "ar")), "left")
    chars = n.where("ctx = ''").count() + 1
    known: DataFrame | None = None
    for k in range(ORDER):
        own = n.where(F.length("ctx") == k).join(left.where(F.length("ctx") == k), "ctx")
        if known is None:
            below = own.withColumn("pa", F.lit(1.0 / chars)).withColumn("pr", F.lit(1.0 / chars))
        else:
            shorter = known.where(F.length("ctx") == k - 1).select(F.col("ctx").alias("tail"), "c", F.col("a").alias("pa"), F.col("r").alias("pr"))
            below = own.withColumn("tail", F.substring(F.col("ctx"), 2, ORDER)).join(shorter, ["tail", "c"])
        level = below.select("ctx", "c", *((F.col(f"n{k}") * F.col(f"u{k}") + F.col(f"l{k}") * F.col(f"p{k}")).alias(k) for k in "ar"))
        known = level if known is None else written(known.unionByName(level), "model")
    return known.unionByName(left.select("ctx", F.lit(None).cast("string").alias("c"), F.col("la").alias("a"), F.col("lr").alias("r")))


def ratio(urls: DataFrame, model: DataFrame) -> DataFrame:
    """urls(text) -> (text, ratio): (log p accepted - log p rejected) by length; distinct texts expected."""
    model = written(model, "model")
    size = model.count()
    side = F.broadcast if size <= MODEL_ROWS else (lambda x: x)
    # numbers of their own, so that a character's row holds eight bytes of its url
    named = written(urls.select("text").withColumn("_id", F.monotonically_increasing_id()), "texts")
    rows = _positions(named, "text", "_id")
    rows = rows.select("_id", "c", *(F.when(F.length("seen") >= k, F.expr(f"right(seen, {k})") if k else F.lit("")).alias(f"x{k}") for k in range(ORDER)))
    grams, left = model.where("c is not null"), model.where("c is null")
    for k in range(ORDER):
        rows = rows.join(side(grams.where(F.length("ctx") == k).select(F.col("ctx").alias(f"x{k}"), "c", F.log("a").alias(f"a{k}"), F.log("r").alias(f"r{k}"))), [f"x{k}", "c"], "left")
    for k in range(1, ORDER):
        rows = rows.join(side(left.where(F.length("ctx") == k).select(F.col("ctx").alias(f"x{k}"), F.log("a").alias(f"la{k}"), F.log("r").alias(f"lr{k}"))), f"x{k}", "left")
    def score(m: str) -> Column:
        out = F.coalesce(F.col(f"{m}0"), F.lit(0.0))
        for k in range(1, ORDER):
            out = F.coalesce(F.col(f"{m}{k}"), F.coalesce(F.col(f"l{m}{k}"), F.lit(0.0)) + out)
        return out

    total = rows.groupBy("_id").agg((F.sum(F.round((score("a") - score("r")) * SCALE).cast("long")) / F.count("*") / SCALE).alias("ratio"))
    return named.join(total, "_id").select("text", "ratio")


def calibrate(scored: DataFrame) -> float:
    """scored(ratio, weight, good) -> the cut with the least sum of both classes' error rates; 0 if a class is missing."""
    bins = scored.groupBy(F.round("ratio", 3).alias("v")).agg(F.sum(F.when(F.col("good"), F.col("weight")).otherwise(0)).alias("g"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("weight"))).alias("b"))
    rows = sorted((r.v, r.g, r.b) for r in bins.collect())  # at most a row for each thousandth
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, cut, lost, kept = None, 0.0, 0, bad
    for k, (v, g, b) in enumerate(rows):
        lost, kept = lost + g, kept - b
        error = lost / good + kept / bad
        if best is None or error < best - 1e-12:
            after = rows[k + 1][0] if k + 1 < len(rows) else v
            best, cut = error, (v + after) / 2
    return cut


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's own ratio and cut."""
    host, path = parts(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("_url"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    named = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_v"), normal(F.col("_url"), F.col("host")).alias("text"))
    urls = written(named.groupBy("text", "_v").agg(F.count("*").alias("weight")), "urls")
    labelled = urls.where("_v is not null").select("text", "weight", (F.col("_v") == "allow").alias("good"))
    held = F.pmod(F.crc32("text"), F.lit(4)) == 0
    fold = labelled.where(held).groupBy("text", "good").agg(F.sum("weight").alias("weight"))
    trial = ratio(fold.select("text").distinct(), train(labelled.where(~held)))
    cut = calibrate(fold.join(trial, "text"))
    # written, so that both sides of the join are plain exchanges and Spark can split the part of a hot url
    scores = written(ratio(urls.where("_v is null and text <> ''").select("text").distinct(), train(labelled)), "scores")
    both = named.join(scores, "text", "left")
    value = F.coalesce("ratio", F.lit(0.0))
    return both.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(value >= cut, "allow").otherwise("block")).alias("verdict"), F.when(F.col("_v").isNull(), value).alias("ratio"), F.lit(cut).alias("cut"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
