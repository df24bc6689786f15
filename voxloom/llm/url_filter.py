"""URL verdicts from host and path rules, else from mined association rules (DataFrame operations only)."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

@dataclass(frozen=True)
class PathRule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(whole, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels, path words and query keys, each with its place."""
    whole = F.lower(F.coalesce(url.cast("string"), F.lit("")))
    host, path = host_and_path(url)
    scheme = F.regexp_extract(whole, r"(?s)\A(.*?)://", 1)
    query = F.regexp_extract(whole, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)\A([^=]*)", 1))
    place = lambda tag, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(tag), w))
    return F.array_distinct(F.concat(place("s:", F.array(scheme)), place("h:", F.split(host, r"[.:@]")), place("p:", F.split(F.lower(path), r"[/.]")), place("q:", keys)))


def vocabulary(labelled: DataFrame, least: int) -> DataFrame:
    """(item, rep, n, bad): the tokens that stand in ``least`` bad baskets or more, by groups of the same baskets.

    Tokens that stand in exactly the same baskets (two 64-bit sums over these agree) are one for mining; the smallest
    represents them. There are at most ``tokens of a bad basket / share`` such tokens, where ``share`` is ``least`` over the bad
    baskets.
    """
    each = labelled.select("row", "bad", F.explode("items").alias("item"))
    mark = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(20,0)"))
    seen = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), mark(1).alias("m1"), mark(2).alias("m2")).filter(F.col("bad") >= least)
    reps = seen.groupBy("m1", "m2", "n", "bad").agg(F.min("item").alias("rep"))
    return seen.join(reps, ["m1", "m2", "n", "bad"]).select("item", "rep", "n", "bad")


def translated(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(row, items): the tokens of each row as their representatives; rows without any go."""
    return rows.select("row", F.explode("items").alias("item")).join(F.broadcast(words.select("item", "rep")), "item").groupBy("row").agg(F.collect_set("rep").alias("items"))


def matched(rows: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """Each of ``rows`` (row, items) with each of ``rules`` (antecedent, weight of each item, ...) whose antecedent it holds.

    An inverted index files each rule under its rarest item, so an item that all rows share brings up no candidates unless
    a rule has no other. Up to ``most`` rules are broadcast; more are matched by a shuffle.
    """
    rules = rules.withColumn("item", F.array_min("rarity")["item"]).drop("rarity")
    few = rules.limit(most + 1).count() <= most
    found = rows.select("row", "items", F.explode("items").alias("item")).join(F.broadcast(rules) if few else rules.hint("shuffle_merge"), "item")
    return found.filter(F.size(F.array_except("antecedent", "items")) == 0).drop("items", "item")


def mine(labelled: DataFrame, words: DataFrame, total: int, bad: int, least: int, min_confidence: float, min_lift: float, max_rules: int) -> DataFrame:
    """Rules (antecedent, confidence, support, rarity) that lead to bad labels.

    ``labelled`` has ``row``, ``items`` and ``bad``, ``words`` is its vocabulary(). Antecedents that stand in ``least`` bad
    baskets or more come from FP-growth over the bad baskets alone; how many baskets hold them is counted by the
    index. A rule goes if its confidence or lift is too low, or if a more general rule has no lower
    confidence. All others stay.

    So that tokens that always come together don't give all their combinations, antecedents are made of
    representatives. Nothing can be added to an item that is always bad without being redundant, so these items give
    rules of their own and take no part in mining.

    Every part of a frequent antecedent is frequent, so the most confident of all more general rules is found size by
    size from the antecedents that lack one item.
    """
    reps = words.filter("item = rep")
    sure = reps.filter("n = bad").select(F.array("rep").alias("antecedent"), "n", "bad")
    mixed = cut(translated(labelled, words.join(reps.filter("bad < n").select("rep"), "rep")).join(labelled.select("row", "bad"), "row"))
    baskets = mixed.filter("bad").select("items")
    rarity = F.transform("antecedent", lambda x: F.struct(F.lit(0).cast("long").alias("n"), x.alias("item")))
    sure = sure.withColumn("rarity", rarity)
    held = baskets.count()
    if held:
        found = FPGrowth(itemsCol="items", minSupport=min(least / held, 1.0)).fit(baskets).freqItemsets
        found = cut(found.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("bad")).filter(F.col("bad") >= least))
        counts = reps.select(F.col("rep").alias("item"), "n")
        rare = found.select("antecedent", "bad", F.explode("antecedent").alias("item")).join(F.broadcast(counts), "item").groupBy("antecedent", "bad").agg(F.collect_list(F.struct("n", "item")).alias("rarity"))
        rare = cut(rare)
        n = matched(mixed.select("row", "items"), rare.select("antecedent", "rarity"), max_rules).groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"))
        sure = sure.unionByName(rare.join(n, "antecedent").select("antecedent", "n", "bad", "rarity"))
    found = cut(sure.select("antecedent", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(total)).alias("support"), "rarity"))
    largest = found.agg(F.coalesce(F.max(F.size("antecedent")), F.lit(0))).first()[0]
    level = cut(found.filter(F.size("antecedent") == 1).withColumns({"above": F.lit(None).cast("double"), "top": F.col("confidence")}))
    rules = level
    for size in range(2, largest + 1):
        own = found.filter(F.size("antecedent") == size)
        shorter = own.select("antecedent", F.explode("antecedent").alias("item")).select("antecedent", F.array_remove("antecedent", F.col("item")).alias("general"))
        above = shorter.join(level.select(F.col("antecedent").alias("general"), "top"), "general").groupBy("antecedent").agg(F.max("top").alias("above"))
        level = cut(own.join(above, "antecedent", "left").withColumn("top", F.greatest("confidence", "above")))
        rules = rules.unionByName(level)
    lift = F.col("confidence") * (total / bad)
    return rules.filter((F.col("confidence") >= min_confidence) & (lift >= min_lift) & (F.col("above").isNull() | (F.col("above") < F.col("confidence")))).select("antecedent", "confidence", "support", "rarity")


def judge(pages: DataFrame, labels: DataFrame, rules: list[PathRule], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", min_support: float = 0.002, min_pages: int = 10, min_confidence: float = 0.6, min_lift: float = 1.5, max_rules: int = 4096) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence.

    The longest of ``rules`` that fits decides. Where none does, mined rules decide: the pages that ``labels``
    covers (same id) are baskets of URL tokens, bad where quality is 0 or toxic is 1; association rules that lead
    to bad labels (see mine()) are matched through an inverted index. A rule rests on ``min_support`` of the
    labelled pages and on ``min_pages`` at least, so that a few pages make none. The verdict is ``block`` if a rule
    matches, with the highest confidence, else ``allow``.

    A null or odd url has an empty host and path, no token, no rule, and the verdict ``allow``. Null labels and
    labels of no page are left out; repeated labels count as bad if one is. Repeated pages are rows of their own.
    Without labelled pages no rule is mined. Up to ``max_rules`` mined rules are broadcast; more are matched by a shuffle.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    rows = cut(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), tokens(url).alias("items"), F.monotonically_increasing_id().alias("row")))

    bad = labels.select(F.col(label_id).alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = cut(rows.join(bad, "page_id").filter(F.size("items") > 0).select("row", "items", "bad"))
    counts = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    decided = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest comes last and overrides
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        decided = decided.withColumn("rule", F.when(fits, r.text).otherwise(F.col("rule"))).withColumn("verdict", F.when(fits, r.verdict).otherwise(F.col("verdict")))
    least = max(ceil(min_support * counts.n - 1e-9), min_pages)
    if counts.bad < least:
        return decided.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"))

    words = cut(vocabulary(labelled, least))
    mined = cut(mine(labelled, words, counts.n, counts.bad, least, min_confidence, min_lift, max_rules).select("antecedent", "confidence", "rarity"))
    hits = matched(translated(rows.select("row", "items"), words), mined, max_rules).groupBy("row").agg(F.max("confidence").alias("confidence"))
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return decided.join(hits, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "confidence")
