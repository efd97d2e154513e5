"""URL filters from listed rules and from association rules, in DataFrame operations only.

A listed rule is a host and a path; it fits the host and all its subdomains if the url's path starts with the
rule's path, and the longest rule that fits decides. Other urls get the mined rules' verdict: Spark's FP-growth
finds the token combinations of blocked labelled urls, rules ``tokens -> block`` below the least confidence are pruned,
and each rule is indexed under its rarest token, so that a url is compared with the rules of its own tokens.

A rule needs evidence, not a share of the corpus: that so many of its labelled urls are blocked must have a chance of
``CHANCE`` at most if urls were blocked at the base rate of all labels (Chernoff's bound of the binomial tail). With
base rate r this takes log(CHANCE) / log(r) blocked urls at least, whatever the size of the corpus, which is the support
that FP-growth is given. Combinations that hold a token which is a rule itself add nothing and are not mined. Tokens that
stand in the same labelled urls are one item of a combination, and any of them stands for it in the urls that are judged.

FP-growth lists all combinations of an item list, 2 to its length, so it is given the blocked urls of ``MOST_ITEMS`` items
at most. A combination that it misses occurs in a longer blocked url; those are searched by levels, counted over all
urls, and only combinations grow that no shorter rule makes needless (``_of_long``). Both together find a rule for every
url that some proven combination fits, whatever ``MOST_ITEMS`` is.

Tokens: the host's name, each of its parent domains, path segments, query keys, scheme, fragment mark.

Defined results: a null url or one without ``://`` has an empty host and path and no tokens, fits no rule and is
allowed. Rows that repeat are judged alike. Without labels no rule is mined and unlisted urls are allowed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.checkpoints import dropped, saved, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
CHANCE, MIN_CONFIDENCE, MOST_ITEMS = 1e-6, 0.5, 14
BLOCK, ALLOW = "=block", "=allow"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, or nulls. The rules are part of the plan, so keep them few."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url, as an array."""
    host, rest = host_of(url), _rest(url)
    names = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(names, i, F.size(names)), ".")))
    segments = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "^(.*?)://", 1)))
    mark = F.when(rest.contains("#"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, segments, keys, scheme, mark)))


def _of_long(sets: DataFrame, good: int, least: int, proven: Column) -> DataFrame | None:
    """(antecedent, n, bad) of proven combinations of two items or more that occur in a blocked url of more than ``MOST_ITEMS``
    items, from ``sets`` (items, n, bad), with ``good`` urls in all that are not blocked; None if there is no such url.

    A combination grows if ``least`` of its urls are blocked, it is not proven, and each of its items excludes urls that
    are not blocked. Without an item that excludes none, a combination has the same such urls and no fewer blocked ones,
    hence no less proof, and fits no fewer urls; the same holds with any further items."""
    sets = sets.withColumns({"row": F.monotonically_increasing_id(), "long": (F.col("bad") > 0) & (F.size("items") > MOST_ITEMS)})
    sets = saved(sets)
    if sets.where("long").isEmpty():
        return None
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("long").alias("long")]
    held = sets.select("row", "n", "bad", "long", F.explode("items").alias("item")).withColumn("items", F.array("item")).drop("item")
    live = saved(held.groupBy("items").agg(*counts).where(F.col("long") & (F.col("bad") >= least) & (F.col("n") - F.col("bad") < good)))
    held = stored(held.join(live.select("items"), "items", "left_semi"))
    found = []
    while not live.isEmpty():
        # in each url, combinations that differ in their last item only make the next ones
        size = F.size("items")
        heads = held.groupBy("row", "n", "bad", "long", F.slice("items", 1, size - 1).alias("head")).agg(F.array_sort(F.collect_list(F.element_at("items", -1))).alias("ends"))
        pairs = heads.select("*", F.posexplode("ends").alias("at", "one")).withColumn("two", F.explode(F.slice("ends", F.col("at") + 2, F.size("ends"))))
        grown = pairs.select("row", "n", "bad", "long", F.concat("head", F.array("one", "two")).alias("items"))
        sums = saved(grown.groupBy("items").agg(*counts).where(F.col("long") & (F.col("bad") >= least)))
        # all that lack one item must have grown, with more urls that are not blocked
        parts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.filter("items", lambda x, at: at != i))
        parts = sums.select("items", "n", "bad", F.explode(parts).alias("part")).join(live.select(F.col("items").alias("part"), (F.col("n") - F.col("bad")).alias("part_good")), "part")
        whole = parts.groupBy("items", "n", "bad").agg(F.count("*").alias("parts"), F.min("part_good").alias("part_good"))
        whole = saved(whole.where((F.col("parts") == size) & (F.col("n") - F.col("bad") < F.col("part_good"))).select("items", "n", "bad", proven.alias("rule")))
        found.append(whole.where("rule").select(F.col("items").alias("antecedent"), "n", "bad"))
        live = whole.where("not rule and n > bad")
        last, held = held, stored(grown.join(live.select("items"), "items", "left_semi"))
        dropped(last)
    dropped(held)
    return reduce(DataFrame.unionByName, found) if found else None


def mine(labelled: DataFrame, chance: float = CHANCE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules tokens -> block from ``labelled`` (url, blocked boolean): antecedent, token: its rarest one, confidence, n: its labelled
    urls, alike: for each of the antecedent the tokens of the same labelled urls, any of which may stand for it."""
    from pyspark.ml.fpm import FPGrowth

    baskets = saved(labelled.where("url is not null and blocked is not null").select(tokens_of(F.col("url")).alias("items"), F.col("blocked").cast("long").alias("bad")))
    n, bad = baskets.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not 0 < bad < n:  # no rule can lift the rate
        return baskets.sparkSession.createDataFrame([], "antecedent array<string>, token string, confidence double, n long, alike array<array<string>>")
    base = bad / n
    least = math.ceil(math.log(chance) / math.log(base))
    share = F.col("bad") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    proven = (share >= min_confidence) & (share > base) & (F.col("n") * (share * F.log(share / base) + rest) >= -math.log(chance))

    single = baskets.select(F.explode("items").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") >= least)
    single = saved(single.withColumn("rule", proven))
    alone = single.where("rule").select(F.array("token").alias("antecedent"), "token", share.alias("confidence"), "n", F.array(F.array("token")).alias("alike"))

    # the other tokens that can take part, by urls that agree in them
    other = single.where("not rule").select("token", F.col("n").alias("freq"))
    held = saved(baskets.withColumn("id", F.monotonically_increasing_id()).select("id", "bad", F.explode("items").alias("token")).join(other, "token"))
    # tokens of the same urls have one sum of hashes of urls; the first of them stands for all
    alike = held.groupBy("token", "freq").agg(F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("two"))
    other = saved(alike.groupBy("freq", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("alike")).select(F.col("alike")[0].alias("token"), "freq", "alike"))
    held = held.join(other.select("token"), "token")
    kept = saved(held.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("items"), F.max("bad").alias("bad")))
    sets = kept.groupBy("items").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    spoilt = kept.where("bad = 1").select("items")
    if spoilt.count() < least:
        return alone
    several = _of_long(sets, n - bad, least, proven)
    spoilt = spoilt.where(F.size("items") <= MOST_ITEMS)
    rows = spoilt.count()
    if rows >= least:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows).fit(spoilt)
        found = model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("antecedent"))
        rarest = found.select("antecedent", F.explode("antecedent").alias("token")).join(other, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
        held = sets.select("items", "n", "bad", F.explode("items").alias("token")).join(rarest, "token").where(F.size(F.array_except("antecedent", "items")) == 0)
        grown = held.groupBy("antecedent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(proven)
        several = grown if several is None else several.unionByName(grown).dropDuplicates(["antecedent"])
    if several is None:
        return alone
    named = several.select("antecedent", share.alias("confidence"), "n", F.explode("antecedent").alias("token")).join(other, "token")
    named = named.groupBy("antecedent", "confidence", "n").agg(F.min_by("token", F.struct("freq", "token")).alias("token"), F.array_sort(F.collect_list(F.struct("token", "alike"))).alias("items"))
    return alone.unionByName(named.select("antecedent", "token", "confidence", "n", F.col("items.alike").alias("alike")))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that some mined rule fits."""
    held = urls.select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    rarest = F.element_at("alike", F.array_position("antecedent", F.col("token")).cast("int"))
    near = held.select("url", "tokens", F.explode("tokens").alias("token")).join(rules.select("alike", F.explode(rarest).alias("token")), "token")
    return near.where(F.forall("alike", lambda x: F.arrays_overlap(x, F.col("tokens")))).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, chance: float = CHANCE, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: its id, host, path, rule (listed, or null), verdict.

    ``labels``: (id, blocked boolean) of some pages, any number of rows of an id."""
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": verdict})
    if labels is not None:
        one = labels.select(F.col("id").alias("_id"), "blocked").groupBy("_id").agg(F.bool_or("blocked").alias("blocked"))
        known = rows.join(one, rows[id_col] == one["_id"]).select("url", "blocked")
        hits = matched(rows.where("said is null and url is not null"), mine(known, chance, min_confidence)).withColumn("hit", F.lit(True))
        rows = rows.join(hits, "url", "left")
    else:
        rows = rows.withColumn("hit", F.lit(None).cast("boolean"))
    return rows.select(F.col(id_col), "host", "path", "rule", F.coalesce("said", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
