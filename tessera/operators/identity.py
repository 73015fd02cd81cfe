"""Identity resolution: blocked pairs, scores, decisions. A name alone never merges anyone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import dice_of, fold_name, fold_org, norm_url, numbered_bigrams
from tessera.functions.store import ship, stored
from tessera.operators.joins import block
from tessera.operators.windows import cap_per_group, first_of


#: Sites with more identities are searched by name instead of pairing all; rows of a block of such a search.
SITE, BLOCK = 64, 2000
#: A name this alike counts as similar; what name, website, organisation and place add to a score.
SIMILAR, NAME, WEBSITE, ORGANISATION, PLACE = 0.82, 0.38, 0.48, 0.24, 0.08


def candidate_pairs(observations: DataFrame, identities: DataFrame, per_name: int = 10) -> DataFrame:
    """Pairs that share a provider subject, a folded name or a website. A subject pairs without bound, as it is one account's; a name that many share
    says little, so its first identities stand for it, and a name without Latin letters or digits is none. Of a website see site_pairs."""
    keys = lambda df: df.withColumn("name_", F.nullif(fold_name("name"), F.lit("")))
    pairs = block(keys(observations), keys(identities), {"subject": None, "name_": per_name})
    return pairs.unionByName(site_pairs(observations, identities)).distinct()


def site_pairs(observations: DataFrame, identities: DataFrame) -> DataFrame:
    """Pairs (observation_id, identity_id) of one website.

    All of them where a site has SITE identities at most. A larger site gives all pairs of similar names, and each observation's best one
    whatever the names: so decisions and reviews are those of all pairs. Of identities that are alike in site, name, place and organisations the first
    two stand for all, as no decision looks at a third.
    """
    o = _folded(observations, "observation_id", "o").filter("o_site <> ''")
    alike = ["i_site", "i_name", "i_place", "i_orgs"]
    i = stored(cap_per_group(_folded(identities, "identity_id", "i").filter("i_site <> ''"), alike, [F.asc("identity_id")], 2), "site-identities")
    large = stored(i.groupBy(F.col("i_site").alias("site")).count().filter(F.col("count") > SITE).select("site"), "large-sites")
    if not large.limit(1).count():
        return o.join(i, F.col("o_site") == F.col("i_site")).select("observation_id", "identity_id")
    part = lambda df, mark, how: df.join(large, F.col(f"{mark}_site") == F.col("site"), how)
    few = part(o, "o", "left_anti").join(part(i, "i", "left_anti"), F.col("o_site") == F.col("i_site")).select("observation_id", "identity_id")
    o, i = stored(part(o, "o", "left_semi"), "large-observations"), part(i, "i", "left_semi")
    return few.unionByName(similar_pairs(o, i)).unionByName(best_pairs(o, i))


def similar_pairs(o: DataFrame, i: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Pairs of one site whose names' Dice is over `least`, by prefix filter: two such names share a bigram among their rarest few, so only those few
    meet in a join. Rows as _folded makes them; the bigrams of folded names are so few that their counts make a small table."""
    count = i.select(F.explode("i_grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, key: str, mark: str) -> DataFrame:
        """site and gram of each of a name's rarest bigrams: all but as many as two similar names share at least, and one."""
        names = df.select(key, F.col(f"{mark}_site").alias("site"), F.col(f"{mark}_grams").alias("grams"))
        ranked = names.select("*", F.explode("grams").alias("gram")).join(count, "gram", "left").groupBy(key, "site").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
        kept = F.size("g") - F.floor(F.size("g") * (least / (2 - least)) - 1e-9).cast("int")
        return ranked.select(key, "site", F.explode(F.slice("g", 1, kept)).alias("g")).select(key, "site", "g.gram")

    near = rare(o, "observation_id", "o").join(rare(i, "identity_id", "i"), ["site", "gram"]).select("observation_id", "identity_id").distinct()
    short = o.filter(F.length("o_name") < 2).join(i, (F.col("o_site") == F.col("i_site")) & (F.col("o_name") == F.col("i_name"))).select("observation_id", "identity_id")
    met = near.join(o.select("observation_id", "o_name", "o_grams"), "observation_id").join(i.select("identity_id", "i_name", "i_grams"), "identity_id")
    return met.filter(dice_of("o_name", "o_grams", "i_name", "i_grams") > least).select("observation_id", "identity_id").unionByName(short)


def best_pairs(o: DataFrame, i: DataFrame) -> DataFrame:
    """Each observation's best identity of its site by name, organisations and place: blocks of both sides meet, and a block gives one pair an
    observation, so no pair is listed that doesn't lead somewhere."""
    ship(o.sparkSession)
    blocks = lambda df, site: df.groupBy(site).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    o_blocks, i_blocks = blocks(o, "o_site").withColumnRenamed("o_site", "site"), blocks(i, "i_site").withColumnRenamed("i_site", "site")
    both = stored(o_blocks.withColumnRenamed("blocks", "own").join(i_blocks.withColumnRenamed("blocks", "others"), "site"), "site-blocks")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = o.join(both.withColumnRenamed("site", "at"), F.col("o_site") == F.col("at")).select(F.col("at").alias("site"), own("observation_id", "own").alias("a"), each("others").alias("b"), "observation_id", "o_name", "o_place", "o_orgs", "o_grams")
    right = i.join(both, F.col("i_site") == F.col("site")).select("site", own("identity_id", "others").alias("b"), each("own").alias("a"), "identity_id", "i_name", "i_place", "i_orgs", "i_grams")
    met = left.groupBy("site", "a", "b").cogroup(right.groupBy("site", "a", "b")).applyInPandas(_best_of_block, "observation_id long, identity_id long, score double, durable boolean")
    return met.groupBy("observation_id").agg(F.min_by("identity_id", F.struct(-F.col("score"), ~F.col("durable"), F.col("identity_id"))).alias("identity_id"))


def _best_of_block(o: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
    import numpy as np

    if o.empty or i.empty:
        return pd.DataFrame({"observation_id": [], "identity_id": [], "score": [], "durable": []})
    i = i.sort_values("identity_id", ignore_index=True)

    def shared(a: pd.Series, b: pd.Series) -> np.ndarray:
        """Sizes of the intersections of the sets in a and b."""
        place: dict[str, int] = {}
        for x in b:
            for g in x if x is not None else ():
                place.setdefault(g, len(place))
        left, right = (np.zeros((len(s), len(place)), np.float32) for s in (a, b))
        for m, s in ((left, a), (right, b)):
            for r, x in enumerate(s):
                m[r, [place[g] for g in (x if x is not None else ()) if g in place]] = 1
        return (left @ right.T).astype(np.float64)

    def same(a: pd.Series, b: pd.Series) -> np.ndarray:
        x, y = (np.array(s.fillna("\0").tolist(), object) for s in (a, b))
        return (x[:, None] == y) & (y != "\0") & (x != "\0")[:, None]

    size = lambda s: s.fillna("").str.len().to_numpy()
    m, n = size(o["o_name"])[:, None], size(i["i_name"])[None]
    likeness = np.where(same(o["o_name"], i["i_name"]), 1.0, np.where((m < 2) | (n < 2), 0.0, 2 * shared(o["o_grams"], i["i_grams"]) / np.maximum(1, m + n - 2)))
    score = likeness * NAME + WEBSITE + np.where(shared(o["o_orgs"], i["i_orgs"]) > 0, ORGANISATION, 0.0) + np.where(same(o["o_place"], i["i_place"]), PLACE, 0.0)
    score = np.minimum(1.0, score)
    top = score == score.max(axis=1, keepdims=True)
    sure = top & (likeness > SIMILAR)
    first = np.where(sure.any(axis=1), sure.argmax(axis=1), top.argmax(axis=1))
    at = np.arange(len(o)), first
    return pd.DataFrame({"observation_id": o["observation_id"].to_numpy(), "identity_id": i["identity_id"].to_numpy()[first], "score": score[at], "durable": likeness[at] > SIMILAR})


def _folded(rows: DataFrame, key: str, mark: str) -> DataFrame:
    """What pairs compare, worked out once a row: folded name and its bigrams, site, place and organisations. A fact without a column is null."""
    facts = {"verified": "boolean", "location": "string", "affiliations": "array<string>"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in facts.items() if c not in rows.columns})
    orgs = F.filter(F.transform("affiliations", lambda v: fold_org(v)), lambda v: v != "")
    x = rows.select(key, "verified", F.lower("subject").alias("subject"), fold_name("name").alias("name"), norm_url("website").alias("site"), fold_name("location").alias("place"), orgs.alias("orgs"))
    return x.withColumn("grams", numbered_bigrams(F.col("name"))).select([F.col(c).alias(c if c == key else f"{mark}_{c}") for c in [*x.columns, "grams"]])


def score_pairs(pairs: DataFrame, observations: DataFrame, identities: DataFrame) -> DataFrame:
    """Pairs with score, durable and reasons. Exact subjects and e-mail hashes decide; else name, website, affiliation and location add up. A null is like nothing."""
    x = pairs.join(_folded(observations, "observation_id", "o"), "observation_id").join(_folded(identities, "identity_id", "i"), "identity_id")
    exact = F.coalesce(F.col("o_subject") == F.col("i_subject"), F.lit(False))
    verified = F.col("o_verified") & F.col("i_verified")
    site = F.coalesce(F.col("o_site") == F.col("i_site"), F.lit(False))
    org = F.coalesce(F.arrays_overlap("o_orgs", "i_orgs"), F.lit(False))
    place = F.coalesce(F.col("o_place") == F.col("i_place"), F.lit(False))
    signs = F.struct(F.coalesce(dice_of("o_name", "o_grams", "i_name", "i_grams"), F.lit(0.0)).alias("likeness"), site.alias("site"), org.alias("org"), place.alias("place"), exact.alias("exact"), verified.alias("verified"))

    def judged(s: Column) -> Column:
        blend = F.least(F.lit(1.0), s["likeness"] * NAME + F.when(s["site"], WEBSITE).otherwise(0.0) + F.when(s["org"], ORGANISATION).otherwise(0.0) + F.when(s["place"], PLACE).otherwise(0.0))
        name = F.when(s["likeness"] == 1, "exact name").when(s["likeness"] > SIMILAR, "similar name")
        reasons = F.concat_ws(", ", name, F.when(s["site"], "website"), F.when(s["org"], "affiliation"), F.when(s["place"], "location"))
        return F.struct(
            F.when(s["exact"], F.when(s["verified"], 1.0).otherwise(0.92)).otherwise(blend).alias("score"),
            F.when(s["exact"], s["verified"]).otherwise(s["site"] & (s["likeness"] > SIMILAR)).alias("durable"),
            F.when(s["exact"], F.when(s["verified"], "exact subject").otherwise("unverified subject")).otherwise(reasons).alias("reasons"),
        )

    # As a lambda's argument the signs are worked out once, however often they are used.
    return x.select("observation_id", "identity_id", F.explode(F.transform(F.array(signs), judged)).alias("j")).select("observation_id", "identity_id", "j.*")


def decide(observations: DataFrame, scored: DataFrame) -> DataFrame:
    """One decision an observation: match over 0.92 if durable, review over 0.52, else create."""
    best = first_of(scored, ["observation_id"], [F.desc("score"), F.desc("durable"), F.asc("identity_id")])
    x = observations.select("observation_id").join(best, "observation_id", "left")
    action = F.when((F.col("score") >= 0.92) & F.col("durable"), "match").when(F.col("score") >= 0.52, "review").otherwise("create")
    confidence = F.when(F.col("score").isNull(), 0.9).when(action == "create", F.greatest(F.lit(0.55), 1 - F.col("score"))).otherwise(F.col("score"))
    return x.select("observation_id", action.alias("action"), F.when(action != "create", F.col("identity_id")).alias("identity_id"), confidence.alias("confidence"))


def reviewable_pairs(scored: DataFrame) -> DataFrame:
    """The two best pairs an observation that have a name reason and 0.3 at least."""
    return cap_per_group(scored.filter((F.col("score") >= 0.3) & F.col("reasons").contains("name")), ["observation_id"], [F.desc("score"), F.asc("identity_id")], 2)


def match_policy(verdicts: DataFrame, roster: bool = False) -> DataFrame:
    """verdict after policy: a model's match needs no conflict, its confidence and a strong signal, or two signals."""
    least = 0.75 if roster else 0.8
    sure = (F.col("verdict") == "match") & (F.col("conflicts") == 0) & (F.col("confidence") >= least) & ((F.col("strong_signals") >= 1) & ((F.col("signals") >= 2) | (F.col("confidence") >= 0.85)))
    return verdicts.withColumn("decision", F.when(sure, "match").when(F.col("verdict") == "different", "different").otherwise("review"))


def combine_reviews(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One match and nothing open makes a match; any match or open verdict a review; else the decision stands."""
    v = verdicts.groupBy("observation_id").agg(F.count_if(F.col("decision") == "match").alias("matches"), F.count_if(F.col("decision") == "review").alias("open"))
    x = decisions.join(v, "observation_id", "left").fillna(0, ["matches", "open"])
    return x.select("observation_id", F.when((F.col("matches") == 1) & (F.col("open") == 0), "match").when((F.col("matches") > 0) | (F.col("open") > 0), "review").otherwise(F.col("action")).alias("action"))


def bind_in_batch(observations: DataFrame) -> DataFrame:
    """observation_id, bound_to: the first observation of the same verified subject in the batch, or itself."""
    first = observations.filter("verified").groupBy("subject").agg(F.min("observation_id").alias("first"))
    return observations.join(first, "subject", "left").select("observation_id", F.when(F.col("verified"), F.coalesce("first", "observation_id")).otherwise(F.col("observation_id")).alias("bound_to"))


def upsert_identities(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """subject, candidate_id, status: a binding never changes; who claims a bound subject makes it ambiguous."""
    x = existing.join(observed.withColumnRenamed("candidate_id", "claims"), "subject", "full_outer")
    status = F.when(F.col("candidate_id").isNotNull() & F.col("claims").isNotNull() & (F.col("candidate_id") != F.col("claims")), "ambiguous").when(F.coalesce("candidate_id", "claims").isNotNull(), "resolved").otherwise("unresolved")
    return x.select("subject", F.coalesce("candidate_id", "claims").alias("candidate_id"), status.alias("status"))


def review_decision(hypotheses: DataFrame) -> DataFrame:
    """identity_id, status, confidence after review: the last acceptance stands; none and several open ones are ambiguous."""
    x = hypotheses.groupBy("identity_id").agg(F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "proposed").alias("proposed"), F.max_by("candidate_id", F.when(F.col("state") == "accepted", F.struct("decided_at", "candidate_id"))).alias("candidate_id"))
    status = F.when(F.col("accepted") > 0, "resolved").when(F.col("proposed") > 1, "ambiguous").otherwise("unresolved")
    return x.select("identity_id", status.alias("status"), F.when(F.col("accepted") > 0, 1.0).otherwise(0.5).alias("confidence"))


def match_author(authors: DataFrame, persons: DataFrame) -> DataFrame:
    """(author_id, person_id) where name and institution agree for exactly one person. Both sides are cut to one row for each name
    and institution first, so a name that many share joins institutions and not persons."""
    own = persons.filter(fold_name("name") != "").groupBy(fold_name("name").alias("n_"), F.lower("institution").alias("own")).agg(F.min("person_id").alias("low"), F.max("person_id").alias("high"))
    asked = authors.select("author_id", fold_name("name").alias("n_"), F.lower("institution").alias("at"))
    hits = asked.select("n_", "at").distinct().join(own, "n_").filter(F.contains("at", "own")).groupBy("n_", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    one = hits.filter("low = high").select("n_", "at", F.col("low").alias("person_id"))
    several = hits.filter("low < high").select("n_", "at")
    found = asked.join(one, ["n_", "at"]).groupBy("author_id").agg(F.min("person_id").alias("low"), F.max("person_id").alias("high")).filter("low = high")
    return found.join(asked.join(several, ["n_", "at"]).select("author_id"), "author_id", "left_anti").select("author_id", F.col("low").alias("person_id"))


def hypotheses(observations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Identities that are unverified or bound to another: proposed, with a bounded score."""
    x = observations.join(resolved.select("subject", F.col("candidate_id").alias("bound")), "subject", "left")
    conflict: Column = F.col("bound").isNotNull() & (F.col("bound") != F.col("candidate_id"))
    return x.filter(~F.col("verified") | conflict).select("subject", "candidate_id", F.when(conflict, 0.5).otherwise(F.least(F.lit(0.75), "confidence")).alias("score"))
