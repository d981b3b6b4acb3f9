"""URL filter: written rules first, then association rules mined from labelled URLs with FP-growth.

A URL becomes a set of tokens (scheme, domain suffixes, host labels, path segments, ending, query keys; digits are
masked). URLs that a written rule decides are the labelled ones: their verdict is what the rules predict. FP-growth finds
the rules "tokens => verdict" that reach the least support (a share of the labelled rows, and ``LEAST_ROWS`` of them) and
confidence, but those with a shorter rule of the same verdict, whose tokens are among theirs, that is as sure. Rules are
indexed under their rarest item; a URL looks up its items and checks that the rest of the rule is there. Equal token sets
are judged once.

All frequent tokens of all labelled URLs are mined, however long a URL is (``growth.py`` says how, and what that takes).
The query mines the rules that an open URL, one without a written rule, can use; ``mined_rules`` returns all.

Cases: a null URL, or one without ``://``, has an empty host and path and gets the default verdict unless a rule fits;
repeated rows are judged each; an empty table gives an empty table; extra columns are ignored. Equality of token sets is
equality of a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import growth
from quarry.llm.store import release, stored

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled rows that a mined rule must hold for at least, whatever the share.
LEAST_ROWS = 4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Text of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens, sorted."""
    masked = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = lambda k: F.when(n >= k, F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")))
    segments = F.filter(F.split(masked(path), "[/.]"), lambda s: s != "")
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1)), lambda k: F.concat(F.lit("key:"), masked(k)))
    single = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1))),
        F.when(host != "", suffix(1)),
        F.when(host != "", F.when(n >= 2, suffix(2))),
        F.when(n >= 3, F.concat(F.lit("label:"), F.element_at(labels, 1))),
    )
    every = F.concat(single, F.transform(segments, lambda s: F.concat(F.lit("path:"), s)), keys)
    return F.sort_array(F.array_distinct(F.filter(every, lambda t: t.isNotNull())))


def _mined(labelled: DataFrame, wanted: DataFrame, rows: int, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    least = max(math.ceil(min_support * rows - 1e-9), LEAST_ROWS)
    return growth.mine(labelled, wanted, least, min_confidence)


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Association rules of (tokens, verdict) rows: (rule_id, antecedent, verdict, confidence, support)."""
    rows = labelled.count()
    rules, classes = _mined(labelled, labelled.select("tokens"), rows, min_support, min_confidence)
    # an item stands for each of its tokens
    tokens = classes.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    parts = rules.select("*", F.posexplode("antecedent").alias("at", "item")).join(tokens, "item")
    whole = parts.groupBy("antecedent", "verdict", "confidence", "rows").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"]).alias("choices"))
    start = F.array(F.array()).cast("array<array<string>>")
    chosen = F.aggregate("choices", start, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.array_append(d, t)))))
    each = whole.select(F.explode(chosen).alias("tokens"), "verdict", "confidence", (F.col("rows") / F.lit(max(rows, 1))).alias("support"))
    antecedent = F.sort_array("tokens")
    return each.select(F.xxhash64(F.array_join(antecedent, "\n")).alias("rule_id"), antecedent.alias("antecedent"), "verdict", "confidence", "support")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.9,
    default: str = "allow",
    url_col: str = "url",
    id_col: str = "page_id",
) -> DataFrame:
    """Verdict per row: (page_id, host, path, rule, verdict, confidence); confidence is null where no mined rule spoke."""
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = cut.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else F.create_map().cast("map<string,string>")
    seen = stored(known.withColumn("written", F.when(F.col("rule").isNotNull(), F.try_element_at(verdicts, F.col("rule")))).withColumn("key", F.xxhash64("tokens")), "url-tokens")
    labelled = seen.where("written is not null").select("tokens", F.col("written").alias("verdict"))
    rows = labelled.count()
    if not rows:
        return seen.select("page_id", "host", "path", "rule", F.coalesce("written", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    open_sets = stored(seen.where("written is null").groupBy("key").agg(F.first("tokens").alias("tokens")), "url-open")
    found, classes = _mined(labelled, open_sets.select("tokens"), rows, min_support, min_confidence)
    found = stored(found.withColumn("rule_id", F.xxhash64("antecedent", "verdict")), "url-rules")
    held = open_sets.select("key", F.explode("tokens").alias("token")).join(classes.select("token", "item"), "token")
    held = stored(held.groupBy("key").agg(F.collect_set("item").alias("items")), "url-items")
    # the inverted index: each rule under the item that fewest open sets have
    looked = held.select("key", "items", F.explode("items").alias("item"))
    common = looked.groupBy("item").agg(F.count("*").alias("sets"))
    rarest = found.select("rule_id", F.explode("antecedent").alias("item")).join(common, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("sets", "item")).alias("item"))
    index = stored(found.join(rarest, "rule_id"), "url-index")
    fits = looked.join(index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = fits.groupBy("key").agg(
        F.max(F.struct("confidence", "rows", F.size("antecedent").alias("size"), "verdict")).alias("best")
    ).select("key", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))
    best = stored(best, "url-verdicts")
    release(open_sets, found, classes, held, index)
    return seen.join(best, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("written", "mined", F.lit(default)).alias("verdict"),
        F.when(F.col("written").isNull(), F.col("confidence")).alias("confidence"),
    )
