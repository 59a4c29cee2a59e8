"""URL filters: path rules first, then gradient-boosted trees on lexical features.

Everything on the way of a URL is an SQL expression: the trees are trained by
Spark's own library on a bounded table of labelled URLs and then written out as
nested CASE expressions. Statistics of all suffixes of the labelled URLs are a
broadcast table, which that bound limits as well.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.shared import spare

# Fixed rules of the query: (verdict, host, start of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TREES, DEPTH, SEED = 20, 3, 11
SEED_URLS = 3000
MOST = 50_000  # labelled URLs that training reads at most, and so a bound on their suffixes


def host_of(url: Column) -> Column:
    """A-Z lower-cased; empty for null and where there is no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does; the earlier of two equal ones."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda k: (len(rules[k][1] + rules[k][2]), -k))
    for k in order:
        v, h, p = rules[k]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    part = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))


def features(url: Column, odds: Column, rate: Column) -> dict[str, Column]:
    """Lexical features; ``odds`` and ``rate`` are the statistics of the URL's suffix."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda a, b: a / F.greatest(F.length(b), F.lit(1))
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "labels": count(host, "[^.]+"),
        "digit_ratio": share(count(url, "[0-9]"), url),
        "host_digits": share(count(host, "[0-9]"), host),
        "hyphens": count(host, "-"),
        "symbols": count(url, "[^A-Za-z0-9./:?=&#_-]"),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "host_entropy": entropy(host),
        "url_entropy": entropy(url),
        "suffix_odds": F.coalesce(odds, F.lit(0.0)),
        "suffix_rate": F.coalesce(rate, F.lit(0.0)),
    }


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) from a CSV file or folder with these two columns under a header; label 1 is to be blocked."""
    return spark.read.option("header", True).schema("url string, label int").csv(path)


def seed_urls(spark: SparkSession, n: int = SEED_URLS) -> DataFrame:
    """(url, label): a labelled table made from a rule; label 1 is to be blocked.

    Wanted URLs have pronounceable hosts and page paths. Unwanted ones have the
    forms of advertising, spam and typing traps: hyphenated bait words, digits in
    hosts, long random labels, many parameters. The words are examples of the
    form only: no feature sees a word.
    """
    draw = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(1_000_003)).cast("int")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), draw(k) % len(values) + 1)
    parts = ["the", "ther", "on", "ing", "ti", "re", "ea", "sh", "ble", "an", "or", "nd", "st", "ha", "la", "mi", "so", "ra"]
    word = lambda k: F.concat(pick(parts, k), pick(parts, k + 1), F.when(draw(k + 2) % 2 == 0, pick(parts, k + 3)).otherwise(""))
    bait = ["crypto", "jackpot", "vip", "hot", "slots", "lotto", "offer", "promo", "loan", "deal", "bonus", "coupon", "dating", "poker", "mega", "z", "cash", "click"]
    tld = pick(["com", "net", "org", "info", "io", "de", "fr", "es"], 1)
    front = pick(["", "www.", "m.", "blog.", "", "www."], 2)
    site = F.when(draw(3) % 3 == 0, F.concat(word(10), F.lit("."), word(20))).otherwise(word(10))
    number = (draw(4) % 1000).cast("string")
    tail = pick(["", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"], 5)
    page = F.concat(F.lit("/"), pick(["en", "de", "fr", "es", "news", "about"], 6), F.lit("/"), number, tail)
    noise = F.substring(F.md5(F.col("id").cast("string")), 1, 14)
    bad = (
        F.when(draw(7) % 4 == 0, F.concat(noise, F.lit(".example")))
        .when(draw(7) % 4 == 1, F.concat(pick(bait, 30), F.lit("-"), pick(bait, 31), number))
        .otherwise(F.concat(pick(bait, 30), F.lit("-"), pick(bait, 31), F.lit(".example")))
    )
    junk = F.concat(page, F.when(tail.contains("?"), "&").otherwise("?"), F.lit("id="), number, F.lit("&sid="), noise, F.lit("&r=1"))
    label = (F.col("id") % 2).cast("int")
    host = F.concat(front, F.when(label == 1, bad).otherwise(site), F.lit("."), tld)
    path = F.when((label == 1) & (draw(8) % 3 == 0), junk).otherwise(page)
    return spark.range(n).select(F.concat(pick(["https://", "http://"], 9), host, path).alias("url"), label.alias("label"))


@dataclass
class UrlTrees:
    statistics: list[tuple[str, float, float]]  # suffix, log odds of being blocked, share of the labelled URLs
    trees: list[tuple[float, str]]  # weight and the tree as the library prints it
    names: list[str]

    def with_features(self, rows: DataFrame, url: Column, name: str) -> DataFrame:
        """``rows`` with the features of ``url`` as a struct column."""
        suffix, odds, rate = spare(rows, "suffix", "odds", "rate")
        known = rows.sparkSession.createDataFrame(self.statistics, f"{suffix} string, {odds} double, {rate} double")
        joined = rows.withColumn(suffix, suffix_of(host_of(url))).join(F.broadcast(known), suffix, "left")
        return joined.select(*rows.columns, F.struct(*[c.alias(n) for n, c in features(url, F.col(odds), F.col(rate)).items()]).alias(name))

    def score(self, features: Column) -> Column:
        """P(block) from the struct of features: the logistic of twice the boosted margin."""
        total = F.lit(0.0)
        for weight, text in self.trees:
            total = total + F.lit(weight) * _expression(text, [features[n] for n in self.names])
        return 1 / (1 + F.exp(-2 * total))


def _expression(text: str, cols: list[Column]) -> Column:
    """A printed regression tree as nested CASE expressions."""
    lines = [x.strip() for x in text.split("\n") if re.match(r"\s*(If|Else|Predict)", x)]
    at = 0

    def node() -> Column:
        nonlocal at
        line, at = lines[at], at + 1
        if line.startswith("Predict"):
            return F.lit(float(line.partition(":")[2]))
        m = re.match(r"If \(feature (\d+) <= ([-+0-9.Ee]+)\)", line)
        low = node()
        at += 1  # the Else that mirrors the If
        return F.when(cols[int(m[1])] <= float(m[2]), low).otherwise(node())

    return node()


def fit(labelled: DataFrame, most: int = MOST) -> UrlTrees:
    """Train on at most ``most`` labelled URLs (url, label 0 or 1; 1: block), those whose URL hashes lowest.

    Null labels are passed over, null URLs read as empty ones; rows that repeat
    count as often as they occur, with any label. Where one label is missing, as
    in an empty table, no tree is grown and every score is 0.5. Other columns are
    ignored.
    """
    rows = labelled.filter(F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most)
    suffix = suffix_of(host_of(F.col("url")))
    counts = rows.groupBy(suffix.alias("s")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()
    total = sum(r.n for r in counts)
    model = UrlTrees([(r.s, math.log((r.bad + 1) / (r.n - r.bad + 1)), r.n / total) for r in counts], [], list(features(F.lit(""), F.lit(0.0), F.lit(0.0))))
    if sum(r.bad for r in counts) in (0, total):
        return model
    table = model.with_features(rows, F.col("url"), "f").select("label", "f.*")
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="all")
    grown = gbt.fit(VectorAssembler(inputCols=model.names, outputCol="features").transform(table.coalesce(1)))
    model.trees = [(float(w), t.toDebugString) for w, t in zip(grown.treeWeights, grown.trees)]
    return model


def judge(pages: DataFrame, model: UrlTrees, rules=RULES, key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url, ...).

    A rule's verdict stands; without one, a score of one half or more blocks.
    Null and malformed URLs have an empty host and path and are judged by their
    features, URLs of any length as a whole. Null and repeated page_ids keep
    their rows. Other columns are ignored; an empty table gives an empty frame.
    """
    url = F.col("url").cast("string")
    base = model.with_features(pages.select(F.col(key), url.alias("url")), F.col("url"), "f").select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "f")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = base.select(key, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), model.score(F.col("f")).alias("score"))
    return out.select(key, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
