"""URL filters: host word segmentation and naive Bayes.

The words of all pages are the dictionary. A host's names are split into the
likeliest words by their unigram counts (Viterbi); for that, the stretches of
letters and digits of the distinct names meet the dictionary in a join, so
all of it is used and none of it is broadcast. Multinomial naive Bayes over host
and path words learns from the urls that a rule decides and judges the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import commonest, materialize

#: (verdict, rule): a host and all its subdomains, and a path's start.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last to fit wins
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def viterbi(name: str, counts: dict[str, int], total: int, longest: int) -> list[str]:
    """The words of ``name``: the likeliest split under unigram counts.

    A letter that is in no word costs more than any word; letters of such kind
    next to each other are one unknown word. Of equally likely splits the one with
    the longer last word is taken.
    """
    strange = math.log(total + 1) + 1.0
    cost = {w: math.log((total + 1) / n) for w, n in counts.items()}
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        least, at = best[end - 1] + cost.get(name[end - 1], 2 * strange), end - 1
        for start in range(max(0, end - longest), end - 1):
            c = cost.get(name[start:end])
            if c is not None and best[start] + c < least + (1e-9 if start < at else 0.0):
                least, at = best[start] + c, start
        best.append(least)
        back.append(at)
    cuts = [len(name)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    out: list[str] = []
    unknown = False
    for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True):
        part = name[a:b]
        if part in counts:
            out.append(part)
        elif unknown:
            out[-1] += part
        else:
            out.append(part)
        unknown = part not in counts
    return out


def unigrams(pages: DataFrame, longest: int = 20) -> DataFrame:
    """``word, n``: the visible words of all pages, of 2 to ``longest`` letters, counted whole."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " ")
    words = F.explode(F.split(F.lower(plain), r"[^a-z]+")).alias("word")
    return pages.select(words).where(F.length("word").between(2, longest)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def names_of(host: Column) -> Column:
    """The runs of ASCII letters and digits of a host, in order."""
    return F.filter(F.split(host, r"[^a-z0-9]+"), lambda x: x != "")


def path_words(path: Column) -> Column:
    """The runs of letters of a path, in lower case, in order."""
    return F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != "")


def segmented(names: DataFrame, words: DataFrame, longest: int = 20) -> DataFrame:
    """``name, words`` of distinct ``name`` strings, split by :func:`viterbi` under the counts ``word, n``.

    Every stretch of a name of at most ``longest`` letters asks the dictionary, by a
    join; a name's answers are as many as its stretches at most. A name that has no
    word in it is one unknown word.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    stretch = F.expr(f"array_distinct(flatten(transform(sequence(1, length(name)), i -> transform(sequence(2, greatest(2, least({longest}, length(name) - i + 1))), k -> substring(name, i, k)))))")
    asked = names.select("name", F.explode(stretch).alias("ask"))
    found = asked.join(words, F.col("ask") == F.col("word")).groupBy(F.col("name").alias("_n")).agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, known in batches:
            out = [viterbi(name, {k["word"]: k["n"] for k in own or []}, total, longest) for name, own in zip(column.to_pylist(), known.to_pylist(), strict=True)]
            yield pa.array(out, pa.list_(pa.string()))

    joined = names.join(found, F.col("name") == F.col("_n"), "left")
    return joined.select("name", split("name", "known").alias("words"))


def token_counts(labelled: DataFrame) -> DataFrame:
    """``token, block, allow``: how often a token is in urls of either verdict, each time it occurs."""
    one = lambda kind: F.sum((F.col("label") == kind).cast("long")).alias(kind)
    return labelled.select(F.explode("tokens").alias("token"), "label").groupBy("token").agg(one("block"), one("allow"))


def judge_urls(pages: DataFrame, rules=RULES, longest: int = 20, most_sent: int = 200_000) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds`` of every page's url.

    A url that a rule fits has the rule's verdict. Others have the method's: host
    names are segmented into words, and multinomial naive Bayes (add-one smoothing)
    over host and path words, as often as they occur, says block if the odds are
    above even. It learns from all urls that a rule decides; words that none of them
    has say nothing, and if only one verdict or none is to be learned from, all
    others are allowed. Counts and words are whole: of the tokens' odds the
    ``most_sent`` commonest are broadcast, a documented bound, and the others are
    joined. Null urls and urls without ``://`` have an empty host and path, no rule,
    and are allowed. Repeated rows are judged alike; an empty table gives an empty
    result. Other columns of ``pages`` are not used.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.where("host <> ''").select("host").distinct()
    names = hosts.select(F.explode(names_of(F.col("host"))).alias("name")).distinct()
    words = segmented(names, materialize(unigrams(pages, longest)), longest)
    # A host's words: its names' in order. A name such as com is in very many hosts, on the side
    # that Spark may split; the side of the words has each name once.
    parts = hosts.select("host", F.posexplode(names_of(F.col("host"))).alias("pos", "part")).join(words, F.col("part") == F.col("name"))
    split = parts.groupBy(F.col("host").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("w"))
    split = materialize(split.select("_h", F.flatten(F.col("w.words")).alias("words")))
    known = rows.join(split, F.col("host") == F.col("_h"), "left").drop("_h")
    tokens = F.concat(
        F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(path_words(F.col("path")), lambda w: F.concat(F.lit("p:"), w)),
    )
    known = known.withColumn("tokens", tokens).drop("words").withColumn("rule", rule).withColumn("label", verdict)
    known = materialize(known.withColumn("rid", F.monotonically_increasing_id()))

    counts = materialize(token_counts(known.where("label is not null")))
    docs = {r.label: r.n for r in known.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sums = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count(F.lit(1)).alias("v")).first()
    judged = known.withColumn("block_odds", F.lit(-1.0))
    if len(docs) == 2 and sums.v:
        prior = math.log(docs["block"]) - math.log(docs["allow"])
        odds = F.log((F.col("block") + 1) / F.lit(float(sums.b + sums.v))) - F.log((F.col("allow") + 1) / F.lit(float(sums.a + sums.v)))
        table = counts.select("token", odds.alias("odds"), (F.col("block") + F.col("allow")).alias("n"))
        kept, _, distinct = commonest(table, "n", most_sent)
        sent = spark.sparkContext.broadcast({r.token: r.odds for r in kept.select("token", "odds").collect()})
        more = distinct > len(sent.value)
        scored = known.withColumn("s", _common_odds(sent, more)("tokens"))
        if more:
            rest = scored.select("rid", F.explode("s.rest").alias("ask")).join(table, F.col("ask") == F.col("token"))
            rest = rest.groupBy(F.col("rid").alias("_r")).agg(F.sum("odds").alias("rest"))
            scored = scored.join(rest, F.col("rid") == F.col("_r"), "left")
        else:
            scored = scored.withColumn("rest", F.lit(0.0))
        known_odds = F.col("s.odds") + F.coalesce("rest", F.lit(0.0)) + prior
        judged = scored.withColumn("block_odds", F.when(F.col("host") == "", F.lit(-1.0)).otherwise(known_odds))
    method = F.when(F.col("block_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "block_odds")


def _common_odds(sent, more: bool):
    """The sum of the odds of a url's common tokens, and its other tokens."""

    @F.arrow_udf("struct<odds:double,rest:array<string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value
        for column in batches:
            sums, rest = [], []
            for tokens in column.to_pylist():
                sums.append(math.fsum(table.get(t, 0.0) for t in tokens))
                rest.append([t for t in tokens if t not in table] if more else [])
            yield pa.StructArray.from_arrays([pa.array(np.array(sums, np.float64)), pa.array(rest, pa.list_(pa.string()))], names=["odds", "rest"])

    return run
