"""URL filters (operator 2).

Lists of rules decide the urls they cover. For the rest, names run together in hosts and paths
are split into words by the Viterbi recursion over a unigram model counted in the pages' own texts, and a
multinomial naive Bayes model, whose labels are the urls that rules cover, scores the words of host and path.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, pin, table

#: (verdict, rule): a rule is a host, a slash and the beginning of a path; it holds for subdomains too.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words of up to so many letters are looked up by all parts of a run, longer ones by their first letters.
SHORT_WORD = 24


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; null or no `://`: both empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that covers host and path, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        covers = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(covers, hit) if out is None else out.when(covers, hit)
    return out


def url_runs(host: Column, path: Column) -> Column:
    """The runs of letters and the shapes of numbers in host and path, as strings that begin with h or p."""

    def runs(c: Column, mark: str) -> Column:
        found = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
        shape = lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.substring(r, 1, 1), F.lit("#"), F.length(r).cast("string"))).otherwise(r)
        return F.transform(found, lambda r: F.concat(F.lit(mark), shape(r)))

    return F.concat(runs(host, "h"), runs(path, "p"))


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n): how often each run of letters occurs in the text of all pages."""
    text = F.lower(F.regexp_replace("html", r"(?s)<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable words of a run, where known[start, length] counts the parts that are words.

    A part that is no word of length n has the probability 10 / (total * 10^n), n letters of a tenth each after a first factor; so of all
    unknown parts that end at a letter, the best one begins where the score so far less its letters' is highest, and time grows with
    the run's length and its known parts. The earliest cut wins ties.
    """
    letter, first = math.log(10), math.log(10 / total)
    ending: dict[int, list[tuple[int, int]]] = {}
    for (start, size), n in known.items():
        ending.setdefault(start + size, []).append((start, n))
    best: list[tuple[float, int]] = [(0.0, 0)]
    opened, since = 0.0, 0
    for end in range(1, len(run) + 1):
        score, cut = opened + first - end * letter, since
        for start, n in ending.get(end, ()):
            way = best[start][0] + math.log(n / total)
            if way > score or (way == score and start < cut):
                score, cut = way, start
        best.append((score, cut))
        if score + end * letter > opened:
            opened, since = score + end * letter, end
    words, end = [], len(run)
    while end:
        start = best[end][1]
        words.append(run[start:end])
        end = start
    return words[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) for distinct runs (run): each run of letters, however long, split into words.

    The parts of the runs meet the word counts in a join, so the vocabulary is never held in one place. Words of over SHORT_WORD letters meet
    the parts that they begin with, and then the run itself.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    lettered = runs.where(F.col("run").rlike(r"^.\p{L}")).select(F.substring("run", 2, 1 << 30).alias("name")).distinct()
    starts = lettered.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    left = F.length("name") - F.col("start") + 1
    parts = starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(SHORT_WORD), left))).alias("size"))
    short = parts.withColumn("word", F.expr("substring(name, start, size)")).join(words.where(F.length("word") <= SHORT_WORD), "word").select("name", "start", "size", "n")
    long = words.where(F.length("word") > SHORT_WORD).select("word", "n", F.substring("word", 1, SHORT_WORD).alias("head"))
    begun = starts.where(left > SHORT_WORD).withColumn("head", F.expr(f"substring(name, start, {SHORT_WORD})")).join(long, "head").where(F.expr("substring(name, start, length(word)) = word"))
    met = short.unionByName(begun.select("name", "start", F.length("word").alias("size"), "n"))
    known = met.groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))  # the parts of one name

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([best_split(name, {(p["start"] - 1, p["size"]): p["n"] for p in (own if own is not None else ())}, total) for name, own in zip(names, parts, strict=True)], dtype=object)

    found = lettered.join(known, "name", "left").select("name", split("name", "known").alias("words"))
    return runs.withColumn("name", F.substring("run", 2, 1 << 30)).join(found, "name", "left").select("run", F.coalesce("words", F.array("name")).alias("words"))


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url, html).

    The rule's verdict where one covers the url; else block where the log odds of block exceed 0.
    Null url: empty host and path, judged by the prior alone. Null html adds no words.
    Without urls of both verdicts everything that no rule covers is allowed.
    """
    host, path = url_parts(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = pin(parted.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("hit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("runs", url_runs(F.col("host"), F.col("path"))), "urls")
    is_block, is_allow = ((F.col("hit.verdict") == v) for v in ("block", "allow"))
    weight = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    runs = pin(urls.select(F.explode("runs").alias("run"), "hit", "n").groupBy("run").agg(weight(is_block).alias("block"), weight(is_allow).alias("allow")), "runs")
    words = pin(page_words(pages), "words")
    split = pin(segmented(runs.select("run"), words), "segments")
    marked = split.select("run", F.explode("words").alias("word")).withColumn("word", F.concat(F.substring("run", 1, 1), F.col("word")))
    counts = pin(marked.join(runs, "run").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "word-counts")
    all_block, all_allow, kinds = counts.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count("*")).first()
    n_block, n_allow = urls.agg(F.coalesce(weight(is_block), F.lit(0)), F.coalesce(weight(is_allow), F.lit(0))).first()
    trained = n_block > 0 and n_allow > 0
    odds = (F.log((F.col("block") + 1) / F.lit(float(all_block + kinds))) - F.log((F.col("allow") + 1) / F.lit(float(all_allow + kinds)))) if trained else F.lit(0.0)
    run_scores = marked.join(counts.select("word", odds.alias("odds")), "word").groupBy("run").agg(F.sum("odds").alias("odds"))
    prior = math.log(n_block / n_allow) if trained else 0.0
    scored = urls.select("host", "path", F.explode("runs").alias("run")).join(run_scores, "run").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    known = urls.select("host", "path", "hit").join(scored, ["host", "path"], "left").withColumn("score", F.round(F.coalesce("odds", F.lit(0.0)) + prior, 9))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return parted.join(known, ["host", "path"]).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rule or by the words of its host and path."""
    return judged_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op2_url_filter": op2_url_filter}
