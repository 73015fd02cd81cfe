"""URL verdicts from mined association rules, under fixed host and path rules.

Labelled URLs become baskets of tokens; FP-growth mines token combinations, and those that imply the
block label with enough support, confidence and lift over the base rate are rules. Matching goes through an inverted index:
each rule is filed under its rarest token, URL tokens look rules up, and only those are compared whole.

Labels hang on URLs: a page is labelled as blocked if a word of its host is a seed or its own label says so. All other pages stand
against a rule, so its confidence is a lower bound.
FP-growth only proposes rules, and is bounded: tokens that occur in the very same URLs are one item (a rule names them all), and a basket has
at most ITEMS items, those that most often go with the block label. Where no blocked basket is cut, it proposes all rules there are; else the
whole blocked baskets are also gone through set by set. What is proposed is counted again over the whole baskets, and support, confidence
and lift are those of all URLs.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stash, table

BLOCK = "label:block"
#: A rule needs so many labelled URLs, such a share of blocked ones, and such a multiple of the base rate.
MIN_ROWS, MIN_CONFIDENCE, MIN_LIFT = 5, 0.75, 2.0
#: FP-growth's least share of labelled URLs.
MIN_SUPPORT = 0.0001
#: Items of a basket at most.
ITEMS = 12
#: The index is broadcast up to so many rules and shuffled beyond.
BROADCAST_RULES = 20_000
#: A side of a join is broadcast up to so many bytes, as it is in memory.
BROADCAST_BYTES = 32 << 20
#: Words of a host that label a URL as blocked, where nobody labelled it: gambling, pills, adult pages, advertising, fraud.
SEEDS = ("casino", "poker", "bet", "bets", "betting", "lottery", "pill", "pills", "viagra", "pharma", "porn", "sex", "xxx", "escort", "ad", "ads", "adserver", "banner", "track", "tracker", "tracking", "popup", "spam", "scam", "phishing", "malware", "warez")

#: (verdict, host, path) as the contract fixes them.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
    return F.coalesce(*fits)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host words, path words and query keys, each with its kind; digits count as #."""
    low = F.lower(F.coalesce(url, F.lit("")))
    query = F.when(F.instr(low, "?") > 0, F.substring_index(F.substr(low, F.instr(low, "?") + 1), "#", 1)).otherwise("")
    kinds = (("h:", F.split(host_of(low), r"[.:_-]")), ("p:", F.split(F.regexp_replace(path_of(low), "[0-9]+", "#"), r"[/._-]+")), ("q:", F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1))))

    def marked(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))

    return F.array_distinct(F.concat(*[marked(kind, parts) for kind, parts in kinds]))


def seed_label(url: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    """Whether a word of the URL's host is a seed."""
    return F.coalesce(F.arrays_overlap(F.split(host_of(url), r"[.:_-]"), F.array(*map(F.lit, seeds))), F.lit(False))


def sized(side: DataFrame) -> DataFrame:
    """side (strings, numbers and arrays of strings, stored), marked for the join that it is the smaller side of: broadcast if its rows take no more than
    BROADCAST_BYTES, else shuffled.

    The optimizer goes by the size of files. Baskets and sets repeat their items, so theirs are a hundredth of what they take in memory, and it
    would send whole baskets through the driver.
    """
    held = [F.octet_length(F.array_join(c, ",") if kind.startswith("array") else F.col(c).cast("string")) for c, kind in side.dtypes]
    size = side.agg(F.sum(sum((F.coalesce(n, F.lit(0)) for n in held), F.lit(100)))).first()[0] or 0
    return F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("merge")


def _items(baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item, token of the tokens that can be in a rule; and url, blocked, items, with at most ITEMS of them for a URL, cut: whether it has more.

    Tokens that occur in the very same URLs are one item, named by a digest of where it occurs; a token in fewer than MIN_ROWS
    URLs is in no rule.
    """
    rows = baskets.select("url", "blocked", F.explode("tokens").alias("token"))
    place = F.xxhash64("url").cast("decimal(20,0)")
    items = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"), F.sum(place).alias("where"), F.sum(F.xxhash64("url", F.lit(1)).cast("decimal(20,0)")).alias("there"))
    items = items.filter((F.col("n") >= MIN_ROWS) & (F.col("bad") > 0)).select("token", F.concat_ws(":", "n", "where", "there").alias("item"), (F.col("bad") / F.col("n")).alias("share"))
    items = stash(items, "items")
    best = F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "item"))), lambda x: x["item"])), 1, ITEMS)
    own = rows.join(sized(items), "token").groupBy("url", "blocked").agg(best.alias("items"), F.count_distinct("item").alias("n"))
    return items, own.select("url", "blocked", "items", (F.col("n") > ITEMS).alias("cut"))


def _whole(items: DataFrame, baskets: DataFrame) -> DataFrame:
    """url, blocked, items: all that a URL has."""
    whole = baskets.select("url", "blocked", F.explode("tokens").alias("token")).join(sized(items.select("token", "item")), "token").groupBy("url", "blocked").agg(F.collect_set("item").alias("items"))
    return stash(whole, "whole-baskets")


def _size(item: Column) -> Column:
    """URLs that hold an item: its name begins with them."""
    return F.split(item, ":")[0].cast("long")


def recount(rules: DataFrame, whole: DataFrame) -> DataFrame:
    """antecedent, n, bad: URLs of the whole baskets that hold all items of a rule (rules: each once), and those of them that are blocked. Each rule looks
    up the URLs of its rarest item only."""
    anchors = rules.select("antecedent", F.array_min(F.transform("antecedent", lambda x: F.struct(_size(x).alias("size"), x.alias("item"))))["item"].alias("item"))
    met = whole.select("items", "blocked", F.explode("items").alias("item")).join(sized(anchors), "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
    return met.groupBy("antecedent").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"))


def grown(items: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """antecedent: sets of items of whole blocked baskets, each by one item larger than the last, of which at least `least` URLs are blocked.

    Without those that are no rule beside a part of theirs: a set that has as many URLs as one of its parts, or a part that is blocked in
    all of its URLs. Both hold for all larger sets too, so nothing else is lost, and a few URLs of many tokens have few such sets.
    """
    held = whole.filter("blocked").select("url", F.explode("items").alias("item"))
    count = _size(F.col("item"))
    sets = stash(items.select(F.array("item").alias("antecedent"), count.alias("n"), F.round(F.col("share") * count).cast("long").alias("bad")).distinct().filter(F.col("bad") >= least), "sets")
    rows, out = held.select("url", F.array("item").alias("antecedent")), sets.select("antecedent")
    while True:
        sets = sets.filter("bad < n")
        rows = rows.join(sets.select("antecedent").hint("merge"), "antecedent", "left_semi")
        one = lambda c: rows.select("url", F.slice("antecedent", 1, F.size("antecedent") - 1).alias("head"), F.element_at("antecedent", -1).alias(c))  # noqa: B023, E731
        rows = stash(one("a").join(one("b").hint("merge"), ["url", "head"]).filter("a < b").select("url", F.concat("head", F.array("a", "b")).alias("antecedent")), "larger-rows")
        larger = recount(stash(rows.groupBy("antecedent").count().filter(F.col("count") >= least).select("antecedent"), "larger"), whole)
        parts = larger.withColumn("part", F.explode(F.transform("antecedent", lambda x: F.array_except("antecedent", F.array(x)))))
        free = parts.join(sets.select(F.col("antecedent").alias("part"), F.col("n").alias("part_n")).hint("merge"), "part").filter("part_n > n").groupBy("antecedent", "n", "bad").count().filter(F.col("count") == F.size("antecedent"))
        sets = stash(free.select("antecedent", "n", "bad"), "sets")
        if not sets.take(1):
            return out
        out = out.unionByName(sets.select("antecedent"))


def mine_rules(labelled: DataFrame) -> DataFrame:
    """rule_id, anchor, antecedent, confidence, support from (url, blocked); every labelled URL counts once, as blocked if any row says so.

    A rule is dropped if one of its parts is a rule of at least its confidence. No labels, or none that block: no rules.
    """
    spark = labelled.sparkSession
    one = labelled.filter("blocked IS NOT NULL AND url IS NOT NULL").groupBy("url").agg(F.max("blocked").alias("blocked"))
    baskets = stash(one.select("url", url_tokens(F.col("url")).alias("tokens"), "blocked").filter("size(tokens) > 0"), "baskets")
    n, bad = baskets.agg(F.count("*"), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
    schema = "rule_id long, anchor string, antecedent array<string>, confidence double, support double"
    if not bad:
        return spark.createDataFrame([], schema)
    items, urls = _items(baskets)
    with_label = stash(urls.select(F.when(F.col("blocked"), F.array_append("items", BLOCK)).otherwise(F.col("items")).alias("items"), (F.col("blocked") & F.col("cut")).alias("cut")), "item-baskets")
    total = with_label.count()
    if not total:
        return spark.createDataFrame([], schema)
    least = max(MIN_SUPPORT, MIN_ROWS * MIN_CONFIDENCE / total)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=MIN_CONFIDENCE / 2).fit(with_label)
    proposed = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select(F.sort_array("antecedent").alias("antecedent"))
    whole = _whole(items, baskets)
    if with_label.filter("cut").take(1):
        proposed = proposed.unionByName(grown(items, whole, least * total)).distinct()
    counted = recount(stash(proposed, "proposed-rules"), whole)
    confidence = F.col("bad") / F.col("n")
    sure = (F.col("n") >= MIN_ROWS) & (confidence >= MIN_CONFIDENCE) & (confidence >= MIN_LIFT * bad / n)
    found = stash(counted.filter(sure).select("antecedent", confidence.alias("confidence"), (F.col("bad") / n).alias("support")), "rules")
    a = found.alias("a")
    part = (F.col("b.confidence") >= F.col("a.confidence")) & (F.size("b.antecedent") < F.size("a.antecedent")) & (F.size(F.array_except("b.antecedent", "a.antecedent")) == 0)
    wide = a.select("a.antecedent", "a.confidence", F.explode("a.antecedent").alias("item")).alias("a").join(sized(found.select("antecedent", "confidence", F.array_min("antecedent").alias("item"))).alias("b"), (F.col("a.item") == F.col("b.item")) & part, "left_semi").select("antecedent").distinct()
    kept = found.join(wide.hint("merge"), "antecedent", "left_anti").select(F.col("antecedent").alias("rule"), "confidence", "support", F.explode("antecedent").alias("item"))
    named = kept.join(sized(items.select("item", "token")), "item").groupBy("rule", "confidence", "support").agg(F.sort_array(F.collect_set("token")).alias("antecedent"), F.min_by("token", F.struct(_size(F.col("item")), "token")).alias("anchor"))
    return stash(named.select(F.xxhash64("antecedent").alias("rule_id"), "anchor", "antecedent", "confidence", "support"), "index")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and the highest confidence of a rule whose tokens it has, for urls (url, distinct) that match any."""
    n = rules.count()
    index = rules.select(F.col("anchor").alias("token"), "antecedent", "confidence")
    index = sized(index) if n <= BROADCAST_RULES else index.hint("merge")
    tokens = urls.select("url", url_tokens(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("token"))
    hits = tokens.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that blocks; else null) for every row of pages.

    A fixed rule decides where one fits; else a mined rule blocks; else allow. Null and empty URLs have empty host and path and are
    allowed. Repeated rows each get a row; an empty table gives none. URLs of any length are judged whole. Other columns are not read.
    """
    rows = stash(pages.select("page_id", "url"), "urls")
    hits = match_rules(rows.select("url").distinct().filter("url IS NOT NULL"), mine_rules(labelled))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.join(hits.hint("merge"), "url", "left").select("page_id", host.alias("host"), path.alias("path"), "confidence").withColumn("fixed", fixed_rule(F.col("host"), F.col("path")))
    return judged.select("page_id", "host", "path", "fixed.rule", F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked of all pages (page_id, url): those with a seed in their host or a toxic label (doc_id, toxic) of their id."""
    own = labels.filter("toxic = 1").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("toxic")).distinct()
    return pages.join(own.hint("merge"), "page_id", "left").select("url", (seed_label(F.col("url")) | F.coalesce("toxic", F.lit(False))).alias("blocked"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))
