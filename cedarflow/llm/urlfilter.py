"""URL filtering: rules first, then a ratio of character language models.

Rules allow or block a host with all its subdomains under a path's beginning;
the longest wins.  URLs that a rule judges train two smoothed Markov models of
variable order, one for accepted and one for rejected URLs: the probability of a
character mixes contexts of two, one and no characters, each weighted by how
often and how variously the context was seen (Witten and Bell).  A URL that no
rule judges is blocked if the difference of its log-likelihoods, divided by its
length, is over a threshold calibrated on a fold that the models have not seen.

The models read a URL whole, query string and fragment with it; only its scheme is
left out (rules read host and path).  For the threshold, counts leave out that fold
(a fifth of the judged URLs); then they are taken anew over all judged URLs, for the
scores.  Characters fall into 40 classes (letters without case, one class for all
digits, the usual signs, one for everything else), so the models are 64,000 numbers
whatever the size of the input; they go into the plan as a literal.  Log ratios are
rounded to 1/10,000 and summed as integers.  All of it is DataFrame and SQL functions.

Rows: a null url, or one without ``://``, has an empty host and path and no rule; the
models judge it whole, and a null or empty one is allowed, there being nothing
against it; equal URLs are judged alike, and repeated rows, or rows with equal or null
ids, are each judged; ties of the threshold go to the higher one; a very long URL is
read whole; without judged URLs of both kinds, all that no rule judges is allowed; an
empty table gives an empty one.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host (with its subdomains), beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Character classes; a digit is 0, and what is not listed is ~.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0.-/?=&_%#:+~"
A = len(ALPHABET)
UNIT = 10_000
BINS = 400  # of the calibrating histogram, a hundredth wide, around 0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def classes(text: Column) -> Column:
    """The text's characters as numbers of classes, two marks in front, one behind."""
    plain = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"), r"[^a-z0./?=&_%#:+\\-]", "~")
    return F.transform(F.split(F.concat(F.lit("^^"), plain, F.lit("^")), ""), lambda c: F.greatest(F.lit(0), F.instr(F.lit(ALPHABET), c) - 1))


def url_rows(pages: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    said = F.coalesce(F.regexp_replace("url", r"(?s)^.*?://", ""), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), said.alias("said"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "ruled": verdict})


def grams(rows: DataFrame) -> DataFrame:
    """Of URLs with ``cs`` (their classes): the number of each three in a row."""
    at = F.transform(F.sequence(F.lit(0), F.size("cs") - 3), lambda i: (F.get("cs", i) * A + F.get("cs", i + 1)) * A + F.get("cs", i + 2))
    return rows.select("ruled", F.explode(at).alias("g"))


def model(rows: DataFrame) -> DataFrame:
    """One row, ``ratio``: for each of the A**3 numbers of three classes, by how
    much likelier (in 1/UNIT of a natural logarithm) the last one is in rejected
    URLs than in accepted ones, behind the first two."""
    spark = rows.sparkSession
    counts = grams(rows).groupBy("g").agg(F.count_if(F.col("ruled") == "allow").alias("n0"), F.count_if(F.col("ruled") == "block").alias("n1"))
    table = spark.range(0, A**3, 1, 4).select(F.col("id").alias("g")).join(counts, "g", "left").fillna(0, ["n0", "n1"])
    table = table.withColumns({"c": F.col("g") % A, "one": F.floor(F.col("g") / A) % A, "two": F.floor(F.col("g") / A)})
    low = table.groupBy("c").agg(*[F.sum(f"n{k}").alias(f"u{k}") for k in (0, 1)])
    totals = low.agg(*[F.sum(f"u{k}").alias(f"all{k}") for k in (0, 1)], *[F.count_if(F.col(f"u{k}") > 0).alias(f"kinds{k}") for k in (0, 1)])
    mid = table.groupBy("one", "c").agg(*[F.sum(f"n{k}").alias(f"b{k}") for k in (0, 1)])
    mids = mid.groupBy("one").agg(*[F.sum(f"b{k}").alias(f"one_all{k}") for k in (0, 1)], *[F.count_if(F.col(f"b{k}") > 0).alias(f"one_kinds{k}") for k in (0, 1)])
    tops = table.groupBy("two").agg(*[F.sum(f"n{k}").alias(f"two_all{k}") for k in (0, 1)], *[F.count_if(F.col(f"n{k}") > 0).alias(f"two_kinds{k}") for k in (0, 1)])
    # at most A**2 rows on the right of each join
    whole = table.join(F.broadcast(low), "c").join(F.broadcast(mid), ["one", "c"]).join(F.broadcast(mids), "one").join(F.broadcast(tops), "two")
    whole = whole.withColumn("total", totals.select(F.struct("*")).scalar())
    logs = []
    for k in (0, 1):
        u, cu, cv = F.col(f"u{k}"), F.col(f"total.all{k}"), F.col(f"total.kinds{k}")
        p = (u + cv / F.lit(float(A)) + F.lit(1.0 / A)) / (cu + cv + F.lit(1.0))
        p = (F.col(f"b{k}") + F.col(f"one_kinds{k}") * p) / F.greatest(F.col(f"one_all{k}") + F.col(f"one_kinds{k}"), F.lit(1)) + F.when(F.col(f"one_all{k}") == 0, p).otherwise(0.0)
        p = (F.col(f"n{k}") + F.col(f"two_kinds{k}") * p) / F.greatest(F.col(f"two_all{k}") + F.col(f"two_kinds{k}"), F.lit(1)) + F.when(F.col(f"two_all{k}") == 0, p).otherwise(0.0)
        logs.append(F.log(p))
    ratio = F.when((F.col("total.all0") > 0) & (F.col("total.all1") > 0), F.round((logs[1] - logs[0]) * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    pairs = whole.select(F.struct("g", ratio.alias("r")).alias("x"))
    return pairs.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("ratio"))


def scored(rows: DataFrame, ratio: Column) -> DataFrame:
    """With ``score``: the mean log ratio of a URL's characters, in 1/UNIT."""
    total = F.aggregate(F.sequence(F.lit(0), F.size("cs") - 3), F.lit(0).cast("long"), lambda acc, i: acc + F.get(ratio, ((F.get("cs", i) * A + F.get("cs", i + 1)) * A + F.get("cs", i + 2)).cast("int")))
    return rows.withColumn("score", F.when(F.length("said") > 0, F.floor(total / F.greatest(F.size("cs") - 2, F.lit(1)))).cast("long"))


def threshold(held: DataFrame) -> DataFrame:
    """One row, ``least``: the score over which most held-out URLs are rightly
    blocked, the shares of both kinds counting alike; ties go to the higher one."""
    width = UNIT // 100
    bins = held.groupBy(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / width))).alias("bin")).agg(
        F.count_if(F.col("ruled") == "allow").alias("n0"), F.count_if(F.col("ruled") == "block").alias("n1")
    )
    all_bins = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "n0", "n1"))).alias("bs"), F.sum("n0").alias("N0"), F.sum("n1").alias("N1"))  # at most 2 * BINS + 1 of them

    def gain(cut: Column) -> Column:
        kept = lambda f, own: F.aggregate("bs", F.lit(0).cast("long"), lambda acc, b: acc + F.when(own(b["bin"]), b[f]).otherwise(0))
        return kept("n0", lambda x: x <= cut) / F.greatest("N0", F.lit(1)) + kept("n1", lambda x: x > cut) / F.greatest("N1", F.lit(1))

    best = F.array_max(F.transform(F.sequence(F.lit(-BINS), F.lit(BINS)), lambda c: F.struct(gain(c).alias("gain"), c.alias("cut"))))
    return all_bins.select(F.when((F.col("N0") > 0) & (F.col("N1") > 0), (best["cut"] + 1) * width - 1).otherwise(F.lit(2 * BINS * width)).cast("long").alias("least"))


def judge_urls(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, host, path, rule, verdict, and the method's score."""
    rows = url_rows(pages.select("page_id", F.col("url").cast("string").alias("url")))
    rows = rows.withColumn("cs", classes(F.col("said")))
    known = rows.filter("ruled is not null").withColumn("held", F.pmod(F.crc32("url"), F.lit(5)) == 0)
    # A**3 numbers and one number, whatever the input's size; they become literals of the plan
    ratio_of = lambda some: F.split(F.lit(",".join(map(str, model(some).first()["ratio"]))), ",").cast("array<int>")
    least = F.lit(threshold(scored(known.filter("held"), ratio_of(known.filter("not held")))).first()["least"])
    out = scored(rows, ratio_of(known))
    verdict = F.coalesce("ruled", F.when(F.col("score") > least, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("score") / float(UNIT)).alias("score"))
