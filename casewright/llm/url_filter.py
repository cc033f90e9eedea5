"""URL filter: rules of a list first, words of host and path for the rest.

Names in hosts and paths are often several words written together. A unigram
model of words, counted over the text of the pages and over names that are
written with hyphens, splits them: every part of a name that is a known word
comes back from a join with the counts, and a Viterbi walk over the parts of one
name finds the likeliest split. Multinomial naive Bayes then weighs the words.

Its examples are the pages themselves: those with a word of a short seed list in
their host or path are taken as unwanted, the others as wanted. Words that come
with the seeds gain weight, so hosts without any seed word are found too.

Everything is computed once per distinct name, host and path and joined back to
the pages by these, so a host with a third of all pages is split once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import skew
from casewright.llm.registry import query, table
from casewright.session import cut_lineage

# Fixed values: (verdict, rule) of the list, in the order given.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Words whose presence in a host or path marks an example of an unwanted page.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "escort", "gambling", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")

# Longest word of the word model, and the weight of a class for words it has not seen.
LONGEST, SMOOTH = 24, 1.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Runs of letters (or of anything beyond ASCII), and runs of digits.
LETTERS, DIGITS = r"[^\x00-\x60\x7B-\x7F]+", r"[0-9]+"


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in small letters, and path of a URL; both empty without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1), F.lit(""))
    return _folded(F.regexp_extract(after, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def names(text: Column) -> Column:
    """Runs of letters and runs of digits, in order."""
    return F.regexp_extract_all(_folded(text), F.lit(f"{DIGITS}|{LETTERS}"), F.lit(0))


def word_counts(pages: DataFrame, text_col: str | None) -> DataFrame:
    """(word, n): words of the visible text, and parts of names written with a hyphen or underscore in hosts and paths."""
    joined = F.regexp_extract_all(F.concat_ws(" ", "host", F.col("path")), F.lit(r"[^\x00-\x2C\x2E\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"), F.lit(0))
    written = F.filter(joined, lambda x: x.rlike("[-_]"))
    words = F.flatten(F.transform(written, lambda x: F.regexp_extract_all(_folded(x), F.lit(LETTERS), F.lit(0))))
    if text_col is not None:
        # A tag has no angle bracket inside, so broken markup is read once too.
        visible = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<[^<>]*>|&[a-z]+;", " ")
        words = F.concat(words, F.regexp_extract_all(_folded(visible), F.lit(LETTERS), F.lit(0)))
    return pages.select(F.explode(words).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The likeliest split of a name into known words and, at a price for each, other characters."""
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    ends: dict[int, list[tuple[int, float]]] = {}
    for (start, end), weight in known.items():
        ends.setdefault(end, []).append((start, weight))
    for end in range(1, len(name) + 1):
        # One unknown character; neighbouring ones are put together below.
        for start, weight in [(end - 1, unknown), *ends.get(end, [])]:
            if best[start] + weight > best[end]:
                best[end], back[end] = best[start] + weight, start
    cuts, at = [], len(name)
    while at:
        cuts.append((back[at], at))
        at = back[at]
    words: list[str] = []
    loose = ""
    for start, end in reversed(cuts):
        if (start, end) in known and (end - start > 1 or not loose):
            if loose:
                words.append(loose)
                loose = ""
            words.append(name[start:end])
        else:
            loose += name[start:end]
    return [*words, loose] if loose else words


def segmented(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for each distinct name; digits become one word, ``0``."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # A character of no known word costs as much as a word that was seen less than once.
    price = -math.log(total + 1.0) - math.log(10.0)
    plain = distinct.where(~F.col("name").rlike(f"^{DIGITS}$"))
    starts = F.sequence(F.lit(1), F.length("name"))
    spans = plain.select("name", F.explode(starts).alias("start")).select(
        "name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start") + 1))).alias("size"))
    spans = spans.select("name", "start", "size", F.expr("substring(name, start, size)").alias("word"))
    weights = counts.select("word", (F.log("n") - math.log(max(1, total))).alias("weight"))
    hits = spans.join(weights, "word").groupBy("name").agg(F.collect_list(F.struct("start", "size", "weight")).alias("known"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            split = []
            for name, known in zip(frame["name"], frame["known"], strict=True):
                found = {} if known is None else {(k["start"] - 1, k["start"] - 1 + k["size"]): k["weight"] for k in known}
                split.append(viterbi(name, found, price))
            yield pd.DataFrame({"name": frame["name"], "words": split})

    letters = plain.join(hits, "name", "left").mapInPandas(work, "name string, words array<string>")
    return letters.unionByName(distinct.where(F.col("name").rlike(f"^{DIGITS}$")).select("name", F.array(F.lit("0")).alias("words")))


def _spelled(table_: DataFrame, key: str, split: DataFrame) -> DataFrame:
    """(key, words): all words of a distinct host or path; the order does not matter to the model."""
    each = table_.select(key, F.explode(names(F.col(key))).alias("name"))
    return table_.join(skew.lookup(each, split, "name").groupBy(key).agg(F.flatten(F.collect_list("words")).alias("words")), key, "left").select(
        key, F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def weights(examples: DataFrame) -> tuple[DataFrame, float]:
    """(word, weight) and prior of naive Bayes: log odds of unwanted against wanted, over (unwanted, words) of all pages."""
    seen = examples.select("unwanted", F.explode("words").alias("word"))
    bad, good = F.sum(F.col("unwanted").cast("long")), F.sum((~F.col("unwanted")).cast("long"))
    counts = cut_lineage(seen.groupBy("word").agg(bad.alias("bad"), good.alias("good")))
    t = counts.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    p = examples.agg(F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(good, F.lit(0)).alias("good")).first()
    balance = math.log((t["good"] + SMOOTH * max(1, t["words"])) / (t["bad"] + SMOOTH * max(1, t["words"])))
    return counts.select("word", (F.log(F.col("bad") + SMOOTH) - F.log(F.col("good") + SMOOTH) + balance).alias("weight")), math.log((p["bad"] + 1.0) / (p["good"] + 1.0))


def _scored(spelled: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """(key, score): summed weights, rounded before they are added so that their order cannot matter."""
    each = spelled.select(key, F.explode("words").alias("word"))
    exact = F.col("weight").cast("decimal(20,12)")
    sums = skew.lookup(each, model.select("word", exact.alias("weight")), "word").groupBy(key).agg(F.sum("weight").alias("score"))
    return spelled.select(key).join(sums, key, "left").select(key, F.coalesce("score", F.lit(0)).cast("double").alias("score"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules whose host is this one or a domain above it."""
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    met = hosts.withColumn("labels", labels).select("host", F.explode(above).alias("rule_host")).join(rules, "rule_host")
    return met.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "rule_path", F.col("verdict").alias("ruled"))).alias("rules"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS, id_col: str = "page_id", url_col: str = "url", text_col: str | None = "html") -> DataFrame:
    """(id_col, host, path, words, score, rule, verdict) of every row of ``pages``.

    A rule (verdict, ``host/path``) fits its host and all hosts below it, if the
    path of the URL starts with the rule's; of several the longest wins, then the
    first by its text. Where none fits, a positive score means block.

    A null URL, one without ``://`` and an empty one have an empty host and path,
    fit no rule and are judged by the prior alone. Repeated rows and null ids come
    back as often as they are there; long URLs and texts are read whole; an empty
    table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    lean = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = cut_lineage(lean)
    text = pages.select(host.alias("host"), path.alias("path"), *([F.col(text_col)] if text_col is not None else []))
    counts = cut_lineage(word_counts(text, text_col))
    hosts, paths = cut_lineage(urls.select("host").distinct()), cut_lineage(urls.select("path").distinct())
    distinct = hosts.select(F.explode(names(F.col("host"))).alias("name")).union(paths.select(F.explode(names(F.col("path"))).alias("name"))).distinct()
    split = cut_lineage(segmented(distinct, counts))
    host_words, path_words = cut_lineage(_spelled(hosts, "host", split)), cut_lineage(_spelled(paths, "path", split))

    seeded = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])) if seeds else F.lit(False)
    by_host = host_words.select("host", F.col("words").alias("h_words"), seeded.alias("h_seed"))
    by_path = path_words.select("path", F.col("words").alias("p_words"), seeded.alias("p_seed"))
    examples = cut_lineage(
        skew.lookup(skew.lookup(urls.select("host", "path"), by_host, "host"), by_path, "path").select(
            (F.col("h_seed") | F.col("p_seed")).alias("unwanted"), F.concat("h_words", "p_words").alias("words")
        )
    )
    model, prior = weights(examples)
    given = spark.createDataFrame([(v, r, r.partition("/")[0].lower(), r[len(r.partition("/")[0]) :]) for v, r in rules], "verdict string, rule string, rule_host string, rule_path string")
    host_side = _scored(host_words, "host", model).withColumnRenamed("score", "h_score").join(host_rules(hosts, given), "host", "left")
    path_side = _scored(path_words, "path", model).withColumnRenamed("score", "p_score")
    rows = skew.lookup(skew.lookup(urls, cut_lineage(host_side), "host"), cut_lineage(path_side), "path")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-r["size"]).alias("s"), r["rule"].alias("rule"), r["ruled"].alias("ruled")))), 1)
    judged = rows.withColumns({"score": F.col("h_score") + F.col("p_score") + prior, "best": F.when(F.size(F.coalesce(fits, F.array())) > 0, best)})
    verdict = F.coalesce("best.ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "score", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


@query()
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its rule, if one fits, and its verdict."""
    return judge(table(spark, folder, "pages"))
