"""Queries of landing normalizers, expressions, projections and repair."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr as E
from tessera.functions.store import BucketTable, new_folder, upsert
from tessera.operators import repair as R
from tessera.operators import scoring as S
from tessera.operators import views as V
from tessera.plans.bindings import NOW
from tessera.plans.registry import query
from tessera.plans.scoring_queries import PUBLIC
from tessera.sources import html as HT
from tessera.sources import landing as L

LATE = "2002-01-01 00:00:00"


# Landing tables


@query("s01_to_evidence", "orders", oracle="SELECT sha256(concat_ws(chr(31), 'orders', CAST(o_orderkey AS VARCHAR), 'order_placed', strftime(o_orderdate, '%Y-%m-%d'))) AS key, concat('Order ', o_orderpriority) AS title, round(least(1, o_totalprice / 400000), 9) AS confidence FROM orders")
def s01(orders: DataFrame) -> DataFrame:
    x = L.to_evidence(orders, "orders", "order_placed", F.col("o_orderkey"), F.concat(F.lit(" Order\n "), F.col("o_orderpriority")), F.lit("https://e.example/?utm_source=x"), F.col("o_orderdate"), LATE, F.col("o_totalprice") / 400000)
    return x.select("key", "title", F.round("confidence", 9).alias("confidence"))


@query("s03_repositories", "part", oracle="SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_size > 25 THEN 'project_momentum' ELSE 'project_created' END AS type, round((ln(1 + p_size) + ln(1 + p_partkey % 30)) / 40, 6) AS momentum, round(CASE WHEN p_partkey % 4 = 0 THEN least(0.98::DOUBLE, 0.78::DOUBLE + 0.2::DOUBLE * (p_partkey % 100) / 100) ELSE 0.82::DOUBLE END, 6) AS confidence FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0")
def s03(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    repos = part.select(k.alias("repo_id"), F.col("p_name").alias("name"), F.concat(F.lit("https://github.com/u/r"), k).alias("url"), F.col("p_size").alias("stars"), (k % 30).alias("forks"), (k % 5 == 0).alias("fork"), F.when(k % 3 == 0, "org").otherwise("user").alias("owner_type"), F.lit("2024-01-01").alias("pushed_at"), F.when(k % 4 == 0, k % 100 / 100).alias("analysis"))
    return L.normalize_repositories(repos, NOW).select("external_id", "type", F.round("momentum", 6).alias("momentum"), F.round("confidence", 6).alias("confidence"))


@query("s04_activity_profile", "events", oracle=f"SELECT user_id AS profile_id, count(*) AS activity90d, count(DISTINCT CAST(ts AS DATE)) AS active_days, round(least(100, sum(value)), 6) AS commits FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def s04(events: DataFrame) -> DataFrame:
    x = L.normalize_activity(events.select(F.col("user_id").alias("profile_id")).distinct(), events.select(F.col("user_id").alias("profile_id"), "ts", F.col("value").alias("commits")), NOW)
    return x.withColumn("commits", F.round("commits", 6))


WORKS = "SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS a FROM lineitem GROUP BY 1"


def _works(lineitem: DataFrame) -> DataFrame:
    authors = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    x = lineitem.groupBy("l_orderkey").agg(authors.alias("authors"))
    return x.select(F.concat(F.lit("https://doi.org/10.1000/W"), "l_orderkey").alias("doi"), F.concat(F.lit("Work "), "l_orderkey").alias("title"), F.lit("2024-01-01").alias("published"), "authors")


@query("s05_papers", "lineitem", oracle=f"SELECT concat('10.1000/w', CAST(l_orderkey AS VARCHAR), '#author-', CAST(place AS VARCHAR)) AS external_id, CAST(author AS VARCHAR) AS author FROM (SELECT l_orderkey, unnest(a) AS author, unnest(range(len(a))) AS place FROM ({WORKS})) WHERE place < 20")
def s05(lineitem: DataFrame) -> DataFrame:
    return L.normalize_papers(_works(lineitem), NOW).select("external_id", "author")


@query("s06_restrict_to_subject", "lineitem", "supplier", oracle=f"SELECT author, count(*) AS n FROM (SELECT CAST(unnest(a) AS VARCHAR) AS author FROM ({WORKS})) WHERE CAST(author AS INT) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000) GROUP BY 1")
def s06(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    subjects = supplier.filter("s_acctbal >= 5000").select(F.col("s_suppkey").cast("string").alias("author"))
    return L.restrict_to_subject(L.normalize_papers(_works(lineitem), NOW), subjects).groupBy("author").agg(F.count("*").alias("n"))


@query("s07_contest_results", "orders", oracle="SELECT concat(CAST(contest AS VARCHAR), ':m', CAST(o_custkey AS VARCHAR)) AS external_id, round(1 / greatest(1, o_orderkey % 90), 6) AS momentum FROM (SELECT *, o_orderkey % 50 AS contest FROM orders WHERE o_orderstatus <> 'P') WHERE contest IN (SELECT o_orderkey % 50 FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY max(o_orderdate) DESC, 1 DESC LIMIT 5)")
def s07(orders: DataFrame) -> DataFrame:
    x = orders.select((F.col("o_orderkey") % 50).alias("contest_id"), F.col("o_orderdate").alias("ended_at"), (F.col("o_orderstatus") != "P").alias("finished"), F.array(F.concat(F.lit("M"), F.col("o_custkey"))).alias("members"), (F.col("o_orderkey") % 90).alias("place"))
    return L.normalize_contests(x, LATE).select("external_id", F.round("momentum", 6).alias("momentum"))


@query("s08_forum_items", "documents", oracle="SELECT CAST(doc_id AS VARCHAR) AS external_id, (doc_id % 20) + 1.5::DOUBLE * (doc_id % 7) AS momentum, CAST(contains(lower(concat_ws(' ', 'Show HN: x', text)), 'tion') AS INT) + CAST(contains(lower(concat_ws(' ', 'Show HN: x', text)), 'heit') AS INT) AS hits FROM documents WHERE doc_id % 20 >= 2 AND doc_id % 11 <> 0 AND (contains(lower(text), 'tion') OR contains(lower(text), 'heit'))")
def s08(documents: DataFrame) -> DataFrame:
    x = documents.select(F.col("doc_id").alias("item_id"), F.lit("Show HN: x").alias("title"), "text", F.lit("https://e.example/").alias("url"), F.lit("2024-01-01").alias("ts"), (F.col("doc_id") % 20).alias("score"), (F.col("doc_id") % 7).alias("comments"), (F.col("doc_id") % 11 == 0).alias("deleted"))
    return L.normalize_forum(x, ["tion", "heit"], NOW).select("external_id", "momentum", "hits")


@query("s09_feed_entries", "supplier", oracle="SELECT s_suppkey AS entry_id, a AS author FROM (SELECT s_suppkey, unnest([concat('Ada N', CAST(s_nationkey AS VARCHAR)), concat('Grace K', CAST(s_suppkey AS VARCHAR))]) AS a FROM supplier WHERE s_suppkey % 4 <> 0) UNION ALL SELECT s_suppkey, concat('Smith, J', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_suppkey % 4 = 0")
def s09(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    two = F.concat(F.lit("Ada N"), F.col("s_nationkey"), F.lit(", Grace K"), k, F.lit(" and News Team"))
    x = supplier.select(k.alias("entry_id"), F.when(k % 4 == 0, F.concat(F.lit("Smith, J"), k)).otherwise(two).alias("byline"), F.lit("E News").alias("publisher"), F.col("s_name").alias("title"), F.lit("https://e.example/").alias("url"), F.lit("2024-01-01").alias("published"))
    return L.normalize_feeds(x, NOW).select(F.substring_index("external_id", "#", 1).cast("long").alias("entry_id"), "author")


ROSTER = "SELECT c_nationkey AS page_id, concat('Ada C', chr(CAST(97 + c_custkey % 26 AS INT)), chr(CAST(97 + c_custkey // 26 % 26 AS INT)), chr(CAST(97 + c_custkey // 676 % 26 AS INT))) AS name, c_mktsegment AS affiliation, c_custkey % 40 + 1 AS rank, CASE c_custkey % 3 WHEN 0 THEN 'Gold' WHEN 1 THEN 'S' ELSE 'HM' END AS award, c_custkey FROM customer"


def _roster(customer: DataFrame) -> DataFrame:
    sql = ROSTER.replace("FROM customer", "FROM {customer}").replace("c_custkey // 676 % 26", "(c_custkey DIV 676) % 26").replace("c_custkey // 26 % 26", "(c_custkey DIV 26) % 26")
    return customer.sparkSession.sql(sql, customer=customer)


@query("s10_extract_roster", "customer", oracle=f"SELECT page_id, name, concat('https://stats.example/', CAST(min(c_custkey) AS VARCHAR)) AS profile_url, arg_min(affiliation, c_custkey) AS affiliation, arg_min(rank, c_custkey) AS rank, arg_min(CASE award WHEN 'Gold' THEN 'gold' WHEN 'S' THEN 'silver' ELSE 'honorable mention' END, c_custkey) AS recognition FROM ({ROSTER}) GROUP BY page_id, name, c_custkey")
def s10(customer: DataFrame) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), "rank", F.lit("</td><td><a href=\"https://stats.example/"), "c_custkey", F.lit("\">"), "name", F.lit("</a></td><td>"), "affiliation", F.lit("</td><td>"), "award", F.lit("</td></tr>"))
    pages = _roster(customer).groupBy("page_id").agg(F.concat(F.lit("<table><tr><th>Rank</th><th>Contestant</th><th>Country</th><th>Award</th></tr>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return HT.extract_roster(pages).select(F.col("page_id").cast("long").alias("page_id"), "name", "profile_url", "affiliation", "rank", "recognition")


def _markdown(customer: DataFrame) -> DataFrame:
    row = F.concat(F.lit("| "), "rank", F.lit(" | "), "name", F.lit(" | "), "affiliation", F.lit(" | "), "award", F.lit(" |"))
    text = F.concat(F.lit("# Results\n| Rank | Contestant | Country | Award |\n|---|---|---|---|\n"), F.array_join(F.sort_array(F.collect_list(row)), "\n"))
    return _roster(customer).groupBy(F.col("page_id").alias("doc_id")).agg(text.alias("text"))


MEDAL = "CASE award WHEN 'Gold' THEN 'gold medal' WHEN 'S' THEN 'silver medal' ELSE 'honorable mention' END"


@query("s11_roster_markdown", "customer", oracle=f"SELECT page_id AS doc_id, name, affiliation, rank, {MEDAL} AS medal FROM ({ROSTER})")
def s11(customer: DataFrame) -> DataFrame:
    return L.roster_lines(_markdown(customer)).select("doc_id", "name", "affiliation", "rank", "medal")


@query("s12_roster_to_evidence", "customer", oracle=f"SELECT sha256(concat_ws(chr(31), 'roster', concat(lower(name), ':2024'), 'competition_result', '2024-07-01')) AS key, concat(name, ' received a ', {MEDAL}) AS title FROM ({ROSTER})")
def s12(customer: DataFrame) -> DataFrame:
    return L.roster_to_evidence(L.roster_lines(_markdown(customer)), 2024, LATE).select("key", "title")


@query("s13_structured_results", "customer", "nation", oracle=f"SELECT page_id AS page, name, rank, {MEDAL} AS medal FROM ({ROSTER}) WHERE page_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, name) <= 4")
def s13(customer: DataFrame, nation: DataFrame) -> DataFrame:
    rows = _roster(customer).select(F.col("page_id").alias("page"), "name", F.concat(F.lit("Rank "), "rank", F.lit("th")).alias("rank_text"), F.col("award").alias("medal_text"))
    return L.structured_results(rows, nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("page")), 20).select("page", "name", "rank", "medal")


@query("s14_page_evidence", "pages", oracle="SELECT page_id, 'Article' AS kind, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS name, url, NULL::VARCHAR AS published FROM pages")
def s14(pages: DataFrame) -> DataFrame:
    """JSON-LD is put around the pages' own titles; pages carry none themselves."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Article").alias("@type"), title.alias("headline"), F.col("url"))), F.lit("</script>"))
    return HT.page_nodes(pages.select("page_id", F.concat(ld, F.col("html")).alias("html")))


@query("s15_page_links", "pages", oracle="SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) AS href FROM pages)")
def s15(pages: DataFrame) -> DataFrame:
    return L.page_links(pages)


@query("s16_page_main_text", "pages", oracle="""WITH a AS (SELECT page_id, list_sort(list_transform(regexp_extract_all(html, '(?s)<(?:article|main)[^>]*>(.*?)</(?:article|main)>', 1), lambda t: struct_pack(n := length(t), t := t)), 'DESC')[1].t AS t, html FROM pages),
b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(t, nullif(regexp_extract(html, '(?s)<body[^>]*>(.*?)</body>', 1), ''), ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM a)
SELECT page_id, substr(t, 1, 12000) AS text FROM b WHERE t <> '' AND NOT regexp_matches(lower(t), '^(access denied|enable javascript|are you a robot)')""")
def s16(pages: DataFrame) -> DataFrame:
    return L.page_main_text(pages)


#: HTML's named character references, some of which end without a semicolon, as rows of DuckDB SQL.
REFERENCES = ", ".join(f"('{name}', {' || '.join(f'chr({ord(ch)})' for ch in text)})" for name, text in sorted(html5.items()))
#: What stands for code points that a numeric reference can't name.
MISNAMED = " ".join(f"WHEN {n} THEN {f'chr({ord(text)})' if text else repr(text)}" for n in range(160) if (text := unescape(f"&#{n};")) != chr(n))


@query("s17_owned_page_profile", "pages", oracle=f"""WITH named(name, ch) AS (VALUES {REFERENCES}),
t AS (SELECT row_number() OVER () AS r, page_id, html, string_split(regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1), '&') AS parts FROM pages),
u AS (SELECT r, i, parts[i] AS p FROM (SELECT r, parts, unnest(range(2, len(parts) + 1)) AS i FROM t)),
v AS (SELECT r, i, max(x) AS x, arg_max(ch, x) AS ch FROM (SELECT r, i, x, substr(p, 1, x) AS name FROM u, range(2, 33) AS g(x)) JOIN named USING (name) GROUP BY r, i),
n AS (SELECT r, i, CASE WHEN length(ltrim(d, '0')) > 7 THEN 9999999 ELSE CAST(d AS INT) END AS code, after FROM (
  SELECT r, i, regexp_extract(p, '^#([0-9]+)', 1) AS d, regexp_replace(p, '^#[0-9]+;?', '') AS after FROM u WHERE regexp_matches(p, '^#[0-9]')
  UNION ALL SELECT r, i, CASE WHEN length(h) > 6 THEN '9999999' ELSE CAST(CAST(concat('0x', lpad(h, 6, '0')) AS INT) AS VARCHAR) END, after FROM (
    SELECT r, i, ltrim(regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1), '0') AS h, regexp_replace(p, '^#[xX][0-9a-fA-F]+;?', '') AS after FROM u WHERE regexp_matches(p, '^#[xX][0-9a-fA-F]')))),
c AS (SELECT r, i, concat(CASE code {MISNAMED} ELSE CASE WHEN code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) WHEN code BETWEEN 64976 AND 65007 OR code % 65536 >= 65534 THEN '' ELSE chr(code) END END, after) AS text FROM n),
d AS (SELECT r, string_agg(coalesce(c.text, v.ch || substr(p, x + 1), concat('&', p)), '' ORDER BY i) AS rest FROM u LEFT JOIN v USING (r, i) LEFT JOIN c USING (r, i) GROUP BY r)
SELECT page_id, regexp_replace(concat(parts[1], rest), '^[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+|[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+$', '', 'g') AS title, '' AS description, sha256(html) AS content_hash FROM t LEFT JOIN d USING (r)""")
def s17(pages: DataFrame) -> DataFrame:
    return HT.owned_page_profile(pages)


@query("s18_artifacts", "part", oracle="SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_size >= 10 THEN 'project_momentum' ELSE 'project_created' END AS type, 1 + CAST(p_partkey % 3 = 0 AS INT) AS indicators, round(0.3::DOUBLE + 0.08::DOUBLE * (1 + CAST(p_partkey % 3 = 0 AS INT)), 6) AS confidence FROM part WHERE p_partkey % 7 <> 0")
def s18(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    x = part.select(k.alias("artifact_id"), F.col("p_name").alias("name"), F.lit("https://huggingface.co/u/m").alias("url"), F.lit("2024-01-01").alias("updated"), F.col("p_size").alias("likes"), (k % 7 == 0).alias("private"), F.lit(False).alias("gated"), F.when(k % 3 == 0, F.array(F.lit("README.md"), F.lit("config.json"))).otherwise(F.array(F.lit("readme.md"))).alias("files"))
    return L.normalize_artifacts(x, NOW).select("external_id", "type", "indicators", F.round("confidence", 6).alias("confidence"))


@query("s19_people_search", "orders", oracle="SELECT DISTINCT concat('https://p.example/', CAST(o_custkey AS VARCHAR)) AS external_id, date_trunc('week', o_orderdate) AS occurred_at FROM orders")
def s19(orders: DataFrame) -> DataFrame:
    people = F.array(F.struct(F.concat(F.lit("https://p.example/"), F.col("o_custkey")).alias("url"), F.lit("Engineer").alias("job"), F.lit("E").alias("company")))
    return L.normalize_people_search(orders.select(F.col("o_orderdate").alias("found_at"), people.alias("people")), LATE).select("external_id", "occurred_at")


@query("s20_social_posts", "events", oracle="SELECT CAST(event_id AS VARCHAR) AS external_id, event_id % 10 + 2 * (event_id % 4) + 1.5::DOUBLE * (event_id % 3) AS momentum FROM events")
def s20(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    x = events.select(i.alias("post_id"), F.col("event_type").alias("text"), F.lit("https://x.com/u/status/1").alias("url"), "ts", (i % 10).alias("likes"), (i % 4).alias("reposts"), (i % 3).alias("replies"))
    return L.normalize_posts(x, NOW).select("external_id", "momentum")


@query("s21_licensed_profiles", "customer", "events", oracle="SELECT c_custkey AS person_id, round(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 >= 6 THEN least(0.95::DOUBLE, 0.6::DOUBLE + 0.04::DOUBLE * (c_custkey % 10)) ELSE 0.6::DOUBLE END, 6) AS confidence, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 >= 6 THEN 'model-corroborated-identity' ELSE 'identity-review' END AS tag FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-04-20 00:00:00' - INTERVAL 90 DAY)")
def s21(customer: DataFrame, events: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    x = customer.select(k.alias("person_id"), (k % 10).alias("likelihood"), F.when(k % 2 == 0, "match").otherwise("review").alias("decision"))
    recent = events.select(F.col("user_id").alias("person_id"), F.col("ts").alias("discovered_at"))
    return L.licensed_profiles(x, recent, "2024-04-20 00:00:00").withColumn("confidence", F.round("confidence", 6))


@query("s22_manual_profiles", "customer", oracle="SELECT concat('https://www.linkedin.com/in/c', CAST(c_custkey AS VARCHAR)) AS external_id, c_name AS title FROM customer WHERE c_custkey % 3 <> 0")
def s22(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    x = customer.select(F.when(k % 3 == 0, F.lit("https://www.linkedin.com/company/x")).otherwise(F.concat(F.lit("https://www.linkedin.com/in/C"), k)).alias("url"), F.col("c_name").alias("name"), F.lit("2024-01-01").alias("added_at"))
    return L.import_manual(x, NOW).select("external_id", "title")


@query("s23_page_matches", "pages", "supplier", oracle="SELECT page_id, s_suppkey AS person_id, CASE WHEN named AND s_suppkey % 2 = 0 THEN 0.86::DOUBLE WHEN named THEN 0.68::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM (SELECT page_id, s_suppkey, contains(lower(html), CASE s_suppkey % 3 WHEN 0 THEN 'tion' ELSE 'zzz' END) AS named FROM pages JOIN supplier ON regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www[.]', '') <> '' AND page_id // 5 = s_suppkey)")
def s23(pages: DataFrame, supplier: DataFrame) -> DataFrame:
    p = pages.withColumn("h", E.host_of("url")).filter("h IS NOT NULL").select("page_id", F.floor(F.col("page_id") / 5).cast("string").alias("host"), F.col("html").alias("text"))
    s = supplier.select(F.col("s_suppkey").alias("person_id"), F.col("s_suppkey").cast("string").alias("host"), F.when(F.col("s_suppkey") % 3 == 0, "tion").otherwise("zzz").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("known_site"))
    return L.verified_page_matches(p, s)


@query("s24_account_hypotheses", "lineitem", oracle="SELECT person_id, provider, handle, CASE WHEN same THEN 0.8::DOUBLE WHEN q >= 2 THEN 0.74::DOUBLE ELSE 0.6::DOUBLE END AS score FROM (SELECT l_partkey AS person_id, l_returnflag AS provider, min(CAST(l_suppkey AS VARCHAR)) AS handle, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_orderkey) AS q, bool_or(l_suppkey % 5 = 0) AS same FROM lineitem GROUP BY ALL) WHERE n = 1 AND NOT (provider = 'A' AND person_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'))")
def s24(lineitem: DataFrame) -> DataFrame:
    handle = F.col("l_suppkey").cast("string")
    hits = lineitem.select(F.col("l_partkey").alias("person_id"), F.col("l_returnflag").alias("provider"), handle.alias("handle"), F.col("l_orderkey").alias("asked"), F.when(F.col("l_suppkey") % 5 == 0, handle).otherwise("-").alias("known_handle"))
    known = lineitem.filter("l_returnflag = 'A' AND l_linestatus = 'O'").select(F.col("l_partkey").alias("person_id"), F.col("l_returnflag").alias("provider")).distinct()
    return L.account_hypotheses(hits, known)


@query("s25_write_upsert", "orders", oracle="SELECT o_custkey, max(o_totalprice) FILTER (WHERE p = m) AS price, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM (SELECT *, CAST(o_orderkey % 2 = 1 AS INT) AS p, max(CAST(o_orderkey % 2 = 1 AS INT)) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY 1")
def s25(orders: DataFrame) -> DataFrame:
    side = lambda odd: orders.filter(f"o_orderkey % 2 = {odd}").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    return upsert(side(0), side(1), ["o_custkey"], ["price"], first="first_seen", last="last_seen")


@query("s25_upsert_in_buckets", "orders", oracle="SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS last_order, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1")
def s25_buckets(orders: DataFrame) -> DataFrame:
    """Orders come in three batches by date into a table by customer; each rewrites the buckets of its customers."""
    table = BucketTable(orders.sparkSession, new_folder(orders.sparkSession, "upserts"), ["o_custkey"], buckets=16)
    newest = F.max_by("price", "last_order").alias("price")
    merge = lambda old, new: old.unionByName(new).groupBy("o_custkey").agg(newest, F.max("last_order").alias("last_order"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    for n, years in enumerate(("< 1997", "BETWEEN 1997 AND 1999", "> 1999")):
        some = orders.filter(f"year(o_orderdate) {years}").select("o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
        table.apply(some, n, merge)
    return table.rows()


@query("s26_run_ledger", "orders", oracle="SELECT o_custkey AS run_id, n, failed, CASE WHEN NOT ended AND started < TIMESTAMP '1999-01-01' - INTERVAL 15 MINUTE THEN 'failed' WHEN NOT ended THEN 'running' WHEN failed = 0 THEN 'succeeded' WHEN failed < n THEN 'partial' ELSE 'failed' END AS status FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, min(o_orderdate) AS started, bool_or(o_orderstatus = 'P' OR o_orderkey % 3 = 0) AS ended FROM orders GROUP BY 1)")
def s26(orders: DataFrame) -> DataFrame:
    x = orders.select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("outcome"), F.col("o_orderdate").alias("started_at"), ((F.col("o_orderstatus") == "P") | (F.col("o_orderkey") % 3 == 0)).alias("ended"))
    return L.run_ledger(x, "1999-01-01 00:00:00").drop("error")


@query("i11_cross_profile_claims", "pages", oracle="SELECT page_id, 'github' AS provider, concat('u', CAST(page_id % 50 AS VARCHAR)) AS handle, 'rel-me' AS proof FROM pages UNION ALL SELECT page_id, 'x', concat('v', CAST(page_id AS VARCHAR)), 'profile-link' FROM pages")
def i11(pages: DataFrame) -> DataFrame:
    k = F.col("page_id")
    html = F.concat(F.lit('<a href="https://github.com/u'), k % 50, F.lit('">a</a><a rel="me" href="https://www.github.com/U'), k % 50, F.lit('/">b</a><a href="https://x.com/v'), k, F.lit('">c</a><a href="https://x.com/share?u=1">d</a>'), F.col("html"))
    return HT.cross_profile_claims(pages.select("page_id", html.alias("html"))).select("page_id", "provider", "handle", "proof")


# Expressions, as audits over tables


@query("c01_fold_names", "customer", oracle="SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS folded FROM customer")
def c01(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", E.fold_name("c_name").alias("folded"))


@query("c01_fold_texts", "conversations", oracle="SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM conversations")
def c01_texts(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", E.fold_name("text").alias("folded"))


@query("c03_publisher_hosts", "evidence", oracle=f"SELECT coalesce({PUBLIC}, 'none') AS host, count(*) AS n FROM {{evidence}} GROUP BY 1")
def c03(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(F.coalesce(E.publisher_host("source_url"), F.lit("none")).alias("host")).agg(F.count("*").alias("n"))


@query("c04_strip_tracking", "pages", oracle="SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])((utm_[a-z]+|fbclid|gclid|ref)=[^&]*&?)+', '\\1', 'g'), '[?&]$', '') AS url FROM pages")
def c04(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", E.strip_tracking("url").alias("url"))


@query("c08_identifier_audit", "orders", oracle="SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS dois, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS orcids FROM orders")
def c08(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    doi = E.norm_doi(F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1145/X"), k)).otherwise("no doi"))
    orcid = E.orcid_valid(F.when(k % 3 == 0, "https://orcid.org/0000-0002-1825-0097").otherwise("https://orcid.org/0000-0002-1825-0098"))
    return orders.agg(F.count("*").alias("n"), F.count(doi).alias("dois"), F.count_if(orcid).alias("orcids"))


@query("c10_redact_contacts", "documents", oracle="SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[contact redacted]', 'g'), '[+]?[0-9][0-9 ()-]{7,}[0-9]', '[contact redacted]', 'g')) AS text_md5 FROM documents".replace("{2,}", "{{2,}}").replace("{7,}", "{{7,}}"))
def c10(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(E.redact_contact("text")).alias("text_md5"))


@query("c12_constraint_violations", "lineitem", oracle="SELECT 'discount_range' AS rule, count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) AS violations FROM lineitem UNION ALL SELECT 'flag_known', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1))")
def c12(lineitem: DataFrame) -> DataFrame:
    return R.constraint_violations(lineitem, {"discount_range": "l_discount BETWEEN 0 AND 0.05", "flag_known": "l_returnflag IN ('A', 'N')"}, ["l_orderkey", "l_suppkey"])


@query("c13_term_match", "documents", oracle="SELECT doc_id FROM documents WHERE regexp_matches(concat(' ', lower(text), ' '), '[^\\p{{L}}\\p{{N}}](the|von)[^\\p{{L}}\\p{{N}}]')")
def c13(documents: DataFrame) -> DataFrame:
    return documents.filter(E.term_match("text", ["the", "von"])).select("doc_id")


@query("c18_entropy_breadth", "part", oracle="SELECT p_brand, round(CASE WHEN count(*) = 1 THEN 0.2::DOUBLE ELSE least(1, -sum(n / t * ln(n / t)) / ln(least(8, count(*)))) END, 6) AS breadth FROM (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS t FROM part GROUP BY p_brand, p_type) GROUP BY 1")
def c18(part: DataFrame) -> DataFrame:
    n = part.groupBy("p_brand", "p_type").agg(F.count("*").cast("double").alias("n"))
    return n.groupBy("p_brand").agg(F.round(E.entropy_breadth(F.map_from_entries(F.collect_list(F.struct("p_type", "n")))), 6).alias("breadth"))


@query("c19_json_paths", "events", oracle="SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def c19(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k > 50")


@query("c22_private_addresses", "pages", oracle="SELECT count(*) AS n, 0 AS private FROM pages")
def c22(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("n"), F.count_if(E.private_address("url")).alias("private"))


# Projections


@query("p01_search_document", "candidate", "evidence", oracle="""WITH t AS (SELECT candidate_id, concat(type, ': ', title) AS line, row_number() OVER (PARTITION BY candidate_id ORDER BY discovered_at DESC, event_id DESC) AS place FROM {evidence}), e AS (SELECT candidate_id, string_agg(line, '. ' ORDER BY place) AS events FROM t WHERE place <= 30 GROUP BY 1)
SELECT candidate_id, substr(concat_ws(chr(10), name, location, stage, events), 1, 24000) AS text FROM {candidate} LEFT JOIN e USING (candidate_id)""")
def p01(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return V.search_document(candidate, evidence)


@query("p02_confidence_band", "evidence", oracle="SELECT CASE WHEN confidence >= 0.82 THEN 'high' WHEN confidence >= 0.58 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM {evidence} GROUP BY 1")
def p02(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(V.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("p03_event_rollup", "evidence", oracle="SELECT event_id, concat_ws(';', CASE WHEN citations > 0 THEN concat('citations=', CAST(citations AS VARCHAR)) END, CASE WHEN rank > 0 THEN concat('rank=', CAST(rank AS VARCHAR)) END) AS metrics FROM {evidence}")
def p03(evidence: DataFrame) -> DataFrame:
    return V.event_rollup(evidence, ["rank", "citations"])


@query("p04_people_view", "candidate", "evidence", oracle="SELECT candidate_id, max(coalesce(occurred_at, discovered_at)) AS last_activity, count(DISTINCT type) AS types, count(DISTINCT source) AS sources, bool_or(resolution <> 'resolved' OR c.confidence < 0.72) AS warning FROM {candidate} c JOIN {evidence} e USING (candidate_id) GROUP BY 1")
def p04(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    return V.people_view(candidate, evidence)


@query("p05_fallback_summary", "evidence", oracle="SELECT candidate_id, arg_max(title, struct_pack(d := discovered_at, i := event_id)) AS headline, least(12, count(DISTINCT source_url)) AS links, CASE WHEN bool_and(confidence >= 0.85) THEN 'high' WHEN bool_or(confidence < 0.65) THEN 'low' ELSE 'medium' END AS band FROM {evidence} GROUP BY 1")
def p05(evidence: DataFrame) -> DataFrame:
    return V.fallback_summary(evidence)


@query("p06_event_signal_type", "evidence", oracle="SELECT CASE type WHEN 'paper_published' THEN 'research' WHEN 'project_created' THEN 'building' WHEN 'competition_result' THEN 'achievement' WHEN 'social_graph_signal' THEN 'network' ELSE 'other' END AS signal, count(*) AS n FROM {evidence} GROUP BY 1")
def p06(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(V.signal_type(F.col("type")).alias("signal")).agg(F.count("*").alias("n"))


@query("p07_snapshot_copy", "candidate", oracle="SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN name WHEN candidate_id % 3 = 1 THEN location ELSE stage END AS headline, concat(location, chr(10), name) AS summary FROM {candidate}")
def p07(candidate: DataFrame) -> DataFrame:
    from tessera.operators.digest import snapshot_copy

    i = F.col("candidate_id") % 3
    x = candidate.select("candidate_id", "name", F.when(i == 2, F.col("stage")).otherwise(" ").alias("headline"), F.lit("").alias("summary"), F.when(i == 0, F.array(F.lit(" "), "name")).otherwise(F.array("location", "name")).alias("facts"), "location")
    return snapshot_copy(x.withColumn("facts", F.when(F.col("candidate_id") % 3 == 0, F.col("facts")).otherwise(F.col("facts")))).select("candidate_id", "headline", F.when(F.col("candidate_id") % 3 == 0, F.concat("location", F.lit("\n"), "name")).otherwise(F.col("summary")).alias("summary"))


@query("p08_hydrate", "candidate", "evidence", oracle="SELECT candidate_id, count(event_id) AS n, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY discovered_at DESC, event_id DESC), '') AS ids FROM {candidate} LEFT JOIN {evidence} USING (candidate_id) GROUP BY 1")
def p08(candidate: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row a candidate: its pages, each put in order by itself, are joined, so that of a large one no more than its ids meet."""
    ids = F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",")
    pages = V.hydrate(candidate, evidence).select("candidate_id", "page", F.coalesce(F.size("events"), F.lit(0)).cast("long").alias("n"), ids.alias("ids"))
    newest = F.sort_array(F.collect_list(F.struct("page", "ids")))
    return pages.groupBy("candidate_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(newest, lambda p: p["ids"]), ",").alias("ids"))


@query("p09_slugify", "candidate", oracle="SELECT candidate_id, concat(replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), '-', substr(md5(CAST(candidate_id AS VARCHAR)), 1, 8)) AS slug FROM {candidate}")
def p09(candidate: DataFrame) -> DataFrame:
    return candidate.select("candidate_id", V.slugify(F.col("name"), F.col("candidate_id")).alias("slug"))


@query("p10_merge_profile", "customer", "supplier", oracle="SELECT coalesce(c_custkey, s_suppkey) AS person_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, s_name, '-') AS headline, CASE WHEN c_custkey IS NULL THEN concat('n', CAST(s_nationkey AS VARCHAR)) WHEN s_suppkey IS NULL OR s_nationkey = c_nationkey THEN concat('n', CAST(c_nationkey AS VARCHAR)) ELSE concat('n', CAST(c_nationkey AS VARCHAR), ',n', CAST(s_nationkey AS VARCHAR)) END AS affiliations FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def p10(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    n = lambda c: F.array(F.concat(F.lit("n"), F.col(c).cast("string")))
    cur = customer.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("headline"), F.lit(None).cast("string").alias("location"), n("c_nationkey").alias("affiliations"))
    obs = supplier.select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("headline"), F.lit("x").alias("location"), n("s_nationkey").alias("affiliations"))
    return V.merge_profile(cur, obs).select("person_id", F.coalesce("headline", F.lit("-")).alias("headline"), F.array_join("affiliations", ",").alias("affiliations"))


@query("p11_merge_trusted", "customer", "supplier", oracle="SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 AND s_suppkey IS NOT NULL THEN s_name WHEN c_custkey % 2 = 0 THEN c_name ELSE concat('Ada ', c_name) END AS name, s_suppkey IS NOT NULL AND c_custkey % 3 <> 0 AND c_custkey % 5 <> s_suppkey % 7 AS conflict FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def p11(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    cur = customer.select(k.alias("person_id"), F.when(k % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Ada "), "c_name")).alias("name"), F.when(k % 3 != 0, (k % 5).cast("string")).alias("website"))
    obs = supplier.select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).cast("string").alias("website"))
    return V.merge_trusted(cur, obs).select("person_id", "name", "conflict")


@query("p12_status_from_actions", "feedback", oracle="SELECT candidate_id, CASE action WHEN 'accept' THEN 'saved' WHEN 'save' THEN 'saved' WHEN 'watch' THEN 'watching' WHEN 'contact' THEN 'contacted' ELSE 'passed' END AS status FROM {feedback} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, feedback_id DESC) = 1")
def p12(feedback: DataFrame) -> DataFrame:
    return V.status_from_actions(feedback)


@query("f10_brief_contract", "supplier", oracle="SELECT s_suppkey AS brief_id, unnest(CASE s_suppkey % 4 WHEN 0 THEN ['format', 'no_citation'] WHEN 1 THEN ['length'] WHEN 2 THEN ['unknown_citation'] ELSE [] END) AS issue FROM supplier")
def f10(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    known = F.lit("(https://e.example/known)")
    text = F.when(k % 4 == 0, F.concat(F.lit("A claim without a bullet "), k)).when(k % 4 == 1, F.concat(F.lit("- Short "), known)).when(k % 4 == 2, F.concat(F.lit("- A claim that is long enough (https://e.example/"), k, F.lit(")"))).otherwise(F.concat(F.lit("- A claim that is long enough "), known))
    return V.brief_issues(supplier.select(k.alias("brief_id"), text.alias("text")), supplier.limit(1).select(F.lit("https://e.example/known").alias("url")))


@query("f11_plain_language", "documents", oracle="""WITH f AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS t FROM documents),
g AS (SELECT doc_id, len(t) AS facts, len(list_filter(t, lambda x: regexp_matches(lower(x), '\\b(leverage|synergy|cutting-edge|paradigm)\\b'))) AS jargon, len(list_filter(t, lambda x: regexp_matches(lower(x), '\\b(very|really|basically|actually)\\b'))) AS filler, len(list_filter(t, lambda x: len(string_split_regex(trim(x), '\\s+')) > 24)) AS long FROM f) SELECT * FROM g""")
def f11(documents: DataFrame) -> DataFrame:
    """How many of a document's lines, each taken as a fact, carry each flag."""
    facts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    flags = documents.select("doc_id", F.transform(facts, V.plain_language_flags).alias("f"))
    flagged = lambda n: F.size(F.filter("f", lambda x: F.contains(x, F.lit(n)))).alias(n)
    return flags.select("doc_id", F.size("f").alias("facts"), *map(flagged, ("jargon", "filler", "long")))


# Titles hold two words that count, of which all share one, so here facts are near-duplicates exactly if their words are the same.
@query("d03_operator_brief", "evidence", oracle="""WITH f AS (SELECT candidate_id, title AS fact, max(10 * confidence + ln(1 + momentum) + ln(1 + citations) + CASE WHEN rank > 0 THEN 4 / sqrt(rank) ELSE 0 END) AS strength FROM {evidence} GROUP BY 1, 2),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY candidate_id, regexp_replace(fact, '[0-9]+', '') ORDER BY strength DESC, fact) = 1)
SELECT candidate_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY strength DESC, fact) AS INT) AS place, fact FROM b QUALIFY place <= 3""")
def d03(evidence: DataFrame) -> DataFrame:
    return V.operator_brief(evidence.select("candidate_id", F.col("title").alias("fact"), S.event_priority().alias("strength")))


# Repair


@query("r01_quarantine", "evidence", oracle="""WITH i AS (SELECT DISTINCT candidate_id, CAST(event_id % 5 AS VARCHAR) AS subject, event_id % 5 = 0 AS ok FROM {evidence} WHERE source = 'openalex'), w AS (SELECT candidate_id, subject FROM i WHERE NOT ok AND candidate_id IN (SELECT candidate_id FROM i WHERE ok))
SELECT event_id FROM {evidence} e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.candidate_id = e.candidate_id AND w.subject = CAST(e.event_id % 5 AS VARCHAR))""")
def r01(evidence: DataFrame) -> DataFrame:
    x = evidence.withColumn("subject", (F.col("event_id") % 5).cast("string"))
    ids = x.filter("source = 'openalex'").select("candidate_id", "subject", (F.col("subject") == "0").alias("name_matches")).distinct()
    return R.quarantine(x, R.contaminated(ids))[0].select("event_id")


@query("r02_reattribute_shares", "evidence", oracle="SELECT event_id, CASE WHEN source = 'hacker-news' AND type = 'project_created' THEN 'community_recognition' ELSE type END AS type, round(CASE WHEN source = 'hacker-news' AND type = 'project_created' THEN least(0.55::DOUBLE, confidence) ELSE confidence END, 6) AS confidence FROM {evidence}")
def r02(evidence: DataFrame) -> DataFrame:
    return R.reattribute_shares(evidence).select("event_id", "type", F.round("confidence", 6).alias("confidence"))


@query("r04_prune_forks", "evidence", oracle="SELECT event_id FROM {evidence} WHERE event_id % 400 % 10 <> 0")
def r04(evidence: DataFrame) -> DataFrame:
    path = F.regexp_extract("source_url", "^https?://[^/]+/(.+)$", 1)
    repos = evidence.select(path.alias("path"), (F.col("event_id") % 400 % 10 == 0).alias("fork")).distinct()
    return R.prune_forks(evidence, repos)[0].select("event_id")


@query("r05_downgrade_unsupported", "evidence", oracle="SELECT event_id, round(CASE WHEN source = 'people-data-labs' AND tag NOT IN ('verified-provider-subject', 'model-corroborated-identity') THEN least(0.64::DOUBLE, confidence) ELSE confidence END, 6) AS confidence FROM {evidence}")
def r05(evidence: DataFrame) -> DataFrame:
    return R.downgrade_unsupported(evidence).select("event_id", F.round("confidence", 6).alias("confidence"))


@query("r06_recalibrate", "customer", oracle="SELECT c_custkey, CASE 55 + c_custkey % 5 * 5 WHEN 75 THEN 42 WHEN 70 THEN 38 WHEN 65 THEN 35 WHEN 60 THEN 32 ELSE 55 END AS cutoff FROM customer")
def r06(customer: DataFrame) -> DataFrame:
    return R.recalibrate(customer.select("c_custkey", (55 + F.col("c_custkey") % 5 * 5).alias("cutoff")))
