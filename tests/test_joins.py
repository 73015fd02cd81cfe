"""Joins on derived keys and blocks, on rows that the test tables don't have."""

from tessera.operators import identity, joins


def test_authorships_meet_by_work_and_place(spark):
    schema = "id string, doi string, place int"
    left = spark.createDataFrame([("a", "https://doi.org/10.1000/X.1", 1), ("b", "10.1000/x.1", 2), ("c", None, 1), ("d", "no doi", 1)], schema).withColumnRenamed("id", "left_id")
    right = spark.createDataFrame([("p", "10.1000/x.1", 1), ("q", "DOI:10.1000/X.1", 1), ("r", None, 1), ("s", "no doi", 1), ("t", "10.1000/x.1", None)], schema).withColumnRenamed("id", "right_id")
    assert sorted((r["left_id"], r["right_id"]) for r in joins.link_authorships(left, right).collect()) == [("a", "p"), ("a", "q")]


def test_pairs_with_a_common_value_are_never_shuffled(spark):
    """Each pair once, whatever its values have in common; repeated keys, nulls and empty arrays; what shuffles grows with the rows, not with the pairs."""
    left = [(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, ["c"]), (3, ["a"]), (4, []), (5, None), (6, [None]), (None, ["b", None])] + [(100 + i, ["x", "y"]) for i in range(300)]
    right = [(7, ["b", "a"]), (8, ["c", "a"]), (9, ["z"]), (9, ["z"]), (None, ["c"]), (10, [None])] + [(1000 + i, ["y", "x", f"{i % 3}"]) for i in range(400)]
    sets = lambda rows: {k: {x for i, v in rows if i == k for x in v or () if x is not None} for k, _ in rows}
    want = sorted(((i, j) for i, x in sets(left).items() for j, y in sets(right).items() if x & y), key=str)
    tables = spark.createDataFrame(left, "l long, v array<string>"), spark.createDataFrame(right, "r long, v array<string>")
    found = joins.share_any(*tables, "l", "r", "v")
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) > 120_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Deduplicate" not in plan


def test_names_in_other_scripts_pair_nobody(spark):
    schema = "{} long, subject string, website string, name string"
    seen = spark.createDataFrame([(1, "s1", None, "日本 太郎"), (2, "s2", None, "Ünal Örs"), (3, None, None, "")], schema.format("observation_id"))
    known = spark.createDataFrame([(7, "t1", None, "山田 花子"), (8, "t2", None, "unal ors"), (9, None, None, None), (10, "s1", None, "山田")], schema.format("identity_id"))
    assert sorted(map(tuple, identity.candidate_pairs(seen, known).select("observation_id", "identity_id").collect())) == [(1, 10), (2, 8)]


def test_null_names_add_nothing_to_a_score(spark):
    schema = "{} long, verified boolean, subject string, name string, website string, location string, affiliations array<string>"
    seen = spark.createDataFrame([(1, False, None, None, "https://a.example/x", None, None), (2, False, None, "ada king", "https://a.example/x", None, [])], schema.format("observation_id"))
    known = spark.createDataFrame([(7, False, None, "ada king", "https://a.example/x", "here", ["org"])], schema.format("identity_id"))
    pairs = identity.candidate_pairs(seen, known)
    got = {r["observation_id"]: (round(r["score"], 6), r["durable"], r["reasons"]) for r in identity.score_pairs(pairs, seen, known).collect()}
    assert got == {1: (0.48, False, "website"), 2: (0.86, True, "exact name, website")}


PEOPLE = "{} long, name string, website string, subject string, verified boolean, affiliations array<string>, location string"


def judged(spark, seen, known):
    """decisions, reviews and number of pairs of the operator, and the same from all pairs of a site or a name."""
    from pyspark.sql import functions as F

    from tessera.functions.expr import fold_name

    o, i = spark.createDataFrame(seen, PEOPLE.format("observation_id")), spark.createDataFrame(known, PEOPLE.format("identity_id"))
    all_pairs = o.select("observation_id", F.col("website").alias("w")).join(i.select("identity_id", F.col("website").alias("w")), "w").select("observation_id", "identity_id")
    named = [df.withColumn("name_", F.nullif(fold_name("name"), F.lit(""))) for df in (o, i)]
    all_pairs = all_pairs.unionByName(joins.block(*named, {"subject": None, "name_": 10})).distinct()
    out = []
    for pairs in (identity.candidate_pairs(o, i), all_pairs):
        scored = identity.score_pairs(pairs, o, i).cache()
        decided = sorted((r["observation_id"], r["action"], r["identity_id"], round(r["confidence"], 9)) for r in identity.decide(o, scored).collect())
        review = sorted((r["observation_id"], r["identity_id"]) for r in identity.reviewable_pairs(scored).select("observation_id", "identity_id").collect())
        out.append((decided, review, pairs.count()))
    return out


def test_the_last_of_a_site_can_be_the_best(spark):
    """Twelve identities of one site: the name most alike is the twelfth's."""
    site = "https://all.example/"
    known = [(k, "persn " + "abcdefghijkm"[k] * 2, site, f"k{k}", False, [], None) for k in range(11)] + [(11, "persn ll", site, "k11", False, [], None)]
    (decided, _, _), _ = judged(spark, [(1, "Persn L", site, "x", False, [], None)], known)
    assert [(d[1], d[2]) for d in decided] == [("review", 11)]


def test_large_sites_decide_as_all_pairs_do(spark, monkeypatch):
    """A site that holds nearly all rows, with names alike in all degrees, repeated rows, organisations and places."""
    import random

    monkeypatch.setattr(identity, "BLOCK", 90)
    r = random.Random(6)
    syllables = ["mara", "tob", "in", "es", "quil", "va", "le", "orr", "zo", "x"]

    def person(k):
        name = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(2)) if r.random() < 0.95 else r.choice(["", "a", "山田", None])
        return k, name, "https://hot.example/" if r.random() < 0.9 else f"https://{r.randrange(9)}.example/", f"s{k}", r.random() < 0.5, r.choice([[], None, ["Arvenia Lab"], ["arvenia", "Brell"]]), r.choice([None, "Here", "There"])

    seen, known = [person(k) for k in range(150)], [person(k + 1000) for k in range(420)]
    known += [(5000 + k, *known[0][1:3], f"t{k}", *known[0][4:]) for k in range(50)]
    (decided, review, n), (want, want_review, every) = judged(spark, seen, known)
    assert decided == want and review == want_review
    assert n < every / 10


def test_similar_names_of_a_site_of_thousands(spark):
    """Pairs grow with the names that are alike, not with the site's square."""
    import itertools

    schema = PEOPLE
    base = ["".join(p) for p in itertools.product("bdfgk", "aeiou", "lmnpr", "aeiou", "stvz", "aeiou")]
    row = lambda k, name: (k, name, "https://hot.example/", f"s{k}", False, [], None)
    known = spark.createDataFrame([row(k, f"{base[7 * k % len(base)]} {base[11 * k % len(base)]}") for k in range(4000)], schema.format("identity_id"))
    seen = spark.createDataFrame([row(k, f"{base[7 * k % len(base)]} {base[11 * k % len(base)]}x") for k in range(0, 4000, 4)], schema.format("observation_id"))
    o, i = identity._folded(seen, "observation_id", "o"), identity._folded(known, "identity_id", "i")
    pairs = {tuple(x) for x in identity.similar_pairs(o, i).collect()}
    assert {(k, k) for k in range(0, 4000, 4)} <= pairs and len(pairs) < 4000


def test_edges_are_joined_by_more_tasks_as_they_grow(spark, data, monkeypatch):
    from tessera.functions import store
    from tessera.plans import bindings

    def edges():
        return bindings.view(spark, data, "edge").select("source_id", "target_id", "relation", "source_url", "weight", "observed_at")

    turned = lambda: joins.undirected(edges().select("source_id", "target_id"), "source_id", "target_id")
    whole, both = sorted(map(str, edges().collect())), sorted(map(tuple, turned().collect()))
    assert both == sorted(p for r in edges().collect() for p in ((r[0], r[1]), (r[1], r[0])))
    for module in (store, bindings):
        monkeypatch.setattr(module, "ROWS", 500)
    n = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("orders", "lineitem"))
    plan = turned()._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n // 500)}), REPARTITION_BY_NUM" in plan and plan.count("lineitem.parquet") == 1
    assert sorted(map(str, edges().collect())) == whole and sorted(map(tuple, turned().collect())) == both
