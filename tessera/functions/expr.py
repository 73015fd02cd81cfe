"""Column expressions that the operators share. Null in gives null out unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _plain_forms() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition makes of all code points, as far as letters a-z and digits come of it: characters with one such form and those forms, in
    order; combining marks, which go; and characters whose form has several characters."""
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        form = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", c)).lower()
        if re.search("[a-z0-9]", form):
            (one if len(form) == 1 else several)[c] = re.sub("[^a-z0-9]", " ", form)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(one), "".join(one.values()), marks, several


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c(x)))


def log_share(x: Column | str, top: float) -> Column:
    """ln(1 + x) as a share of ln(1 + top)."""
    return F.log1p(c(x)) / F.log1p(F.lit(float(top)))


def fold_name(x: Column | str) -> Column:
    """Compatibility forms taken apart, combining marks off, lower case; anything else but a-z and digits as single spaces. Built-in functions only."""
    from_, to, marks, several = _plain_forms()
    x = c(x)
    # Ligatures and the like are rare: only texts that have one go character by character.
    table = F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in several.items())), F.lit("\n"), F.lit("="))
    apart = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
    whole = F.when(x.rlike("[" + "".join(several) + "]"), apart).otherwise(x)
    plain = F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.translate(whole, from_ + marks, to))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def fold_org(x: Column | str) -> Column:
    """A folded name without words that organisations share."""
    padded = F.concat(F.lit(" "), F.regexp_replace(fold_name(x), " ", "  "), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(padded, " (university|college|inc|llc|ltd|lab|labs|the|of) ", " "), " +", " "))


def host_of(url: Column | str) -> Column:
    """The host of an http(s) URL in lower case without www."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(c(url), "^[hH][tT][tT][pP][sS]?://([^/?#:]+)", 1)), "^www[.]", ""), F.lit(""))


def publisher_host(url: Column | str) -> Column:
    """The host, unless it is local."""
    host = host_of(url)
    return F.when((host != "localhost") & ~host.endswith(".local"), host)


def norm_url(url: Column | str) -> Column:
    """Host without www and path without a trailing slash."""
    path = F.regexp_extract(c(url), "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def strip_tracking(url: Column | str) -> Column:
    """The URL without fragment and tracking parameters."""
    bare = F.regexp_replace(c(url), "#.*$", "")
    bare = F.regexp_replace(bare, "([?&])((utm_[a-z]+|fbclid|gclid|ref)=[^&]*&?)+", "$1")
    return F.regexp_replace(bare, "[?&]$", "")


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the trimmed lower-case parts, joined by a unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.lower(F.trim(F.coalesce(c(p).cast("string"), F.lit("")))) for p in parts]), 256)


def clean_text(x: Column | str, most: int) -> Column:
    """Control characters and runs of white space become one space; cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c(x), "[\\x00-\\x1f\\x7f]", " "), " +", " ")), 1, most)


def redact_contact(x: Column | str) -> Column:
    """E-mail addresses and phone-like numbers are replaced."""
    gone = "[contact redacted]"
    return F.regexp_replace(F.regexp_replace(c(x), "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", gone), "[+]?[0-9][0-9 ()-]{7,}[0-9]", gone)


def orcid_valid(x: Column | str) -> Column:
    """Shape and ISO 7064 mod 11-2 check digit of an ORCID, with or without its URL."""
    bare = F.regexp_extract(c(x), "([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X])$", 1)
    digits = F.regexp_replace(bare, "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: (a + F.substr(digits, i, F.lit(1)).cast("int")) * 2)
    check = (F.lit(12) - total % 11) % 11
    return (bare != "") & (F.substr(digits, F.lit(16), F.lit(1)) == F.when(check == 10, "X").otherwise(check.cast("string")))


def norm_doi(x: Column | str) -> Column:
    """A DOI in lower case, from itself or its URL."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c(x))), "(10[.][0-9]{4,9}/[^ #]+)", 1), F.lit(""))


def doi_author_key(doi: Column | str, place: Column | str) -> Column:
    """DOI and author position: one authorship, the same in every index."""
    return F.when(c(place) >= 0, F.concat(norm_doi(doi), F.lit("#author-"), c(place).cast("string")))


def parse_doi_author_key(x: Column | str) -> Column:
    """struct(doi, place) of an author key, or null."""
    doi, place = norm_doi(F.regexp_extract(c(x), "^(.+)#author-[0-9]+$", 1)), F.regexp_extract(c(x), "#author-([0-9]+)$", 1)
    return F.when(doi.isNotNull() & (place != ""), F.struct(doi.alias("doi"), F.nullif(place, F.lit("")).cast("int").alias("place")))


def profile_url_ok(url: Column | str) -> Column:
    """The canonical URL of a member page of the professional network, or null for any other URL."""
    handle = F.regexp_extract(c(url), "^https://(?:[wW]{3}[.])?(?i:linkedin[.]com)[.]?(?::443)?/in/([A-Za-z0-9_-]{2,150})/?(?:[?#].*)?$", 1)
    return F.when(handle != "", F.concat(F.lit("https://www.linkedin.com/in/"), handle))


def fact_ordinal(n: Column | str) -> Column:
    """1st, 2nd, 3rd, 11th: a whole number of 1 at least, with its ending."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(c(n)).cast("long"))
    ending = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def roster_facts(name: Column | str, event: Column | str, affiliation: Column | str, rank: Column | str, recognition: Column | str) -> Column:
    """Two facts of an official roster entry, as an array; empty if neither rank, recognition nor affiliation is known. The sentences are fixed values."""
    name, event, ranked, award = c(name), c(event), F.coalesce(c(rank) > 0, F.lit(False)), F.lower(c(recognition))
    come = F.when(c(affiliation).isNotNull(), F.concat(name, F.lit(" represented "), c(affiliation), F.lit(" at "), event, F.lit("."))).otherwise(F.concat(name, F.lit(" competed at "), event, F.lit(".")))
    placed = F.concat(name, F.lit(" placed "), fact_ordinal(F.coalesce(c(rank), F.lit(1))), F.lit(" overall"))
    earned = F.concat(F.lit(" earned "), award, F.lit(" recognition."))
    done = F.when(ranked & award.isNotNull(), F.concat(placed, F.lit(" and"), earned)).when(ranked, F.concat(placed, F.lit(" in the official results."))).when(award.isNotNull(), F.concat(name, earned)).otherwise(F.concat(name, F.lit(" appears in the official "), event, F.lit(" results.")))
    return F.when(ranked | award.isNotNull() | c(affiliation).isNotNull(), F.array(come, done)).otherwise(F.array().cast("array<string>"))


def licensed_fact(name: Column | str, description: Column | str, source: str) -> Column:
    """What a licensed profile lists first under work, education or skills, as one fact; null if nothing."""
    lines = F.transform(F.split(c(description), "\n+"), lambda x: F.trim(F.substring_index(F.regexp_extract(F.trim(x), "^(?i:work history|education|listed skills):\\s*(.+)$", 1), ";", 1)))
    detail = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    return F.concat(F.lit(f"{source} lists "), detail, F.lit(" for "), c(name), F.lit("."))


def placement(x: Column | str) -> Column:
    """The rank in texts such as 27, Rank 27th, T27 or 27 (tied)."""
    return F.nullif(F.regexp_extract(F.trim(c(x)), "^(?i:rank +|t)?([0-9]+)(?i:st|nd|rd|th)?( *[(](?i:tied)[)])?$", 1), F.lit("")).cast("int")


def medal(x: Column | str) -> Column:
    low = F.lower(F.trim(c(x)))
    known = {"gold medal": ("g", "gold", "gold medal"), "silver medal": ("s", "silver", "silver medal"), "bronze medal": ("b", "bronze", "bronze medal"), "honorable mention": ("hm", "honorable mention", "honourable mention")}
    return F.coalesce(*[F.when(low.isin(*names), label) for label, names in known.items()])


def bigrams(x: Column) -> Column:
    return F.when(F.length(x) >= 2, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column | str, b: Column | str) -> Column:
    """Multiset bigram Dice: 1 for equal texts, 0 if either is shorter than two."""
    a, b = c(a), c(b)
    x, y = bigrams(a), bigrams(b)
    count = lambda arr, g: F.size(F.filter(arr, lambda e: e == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def numbered_bigrams(x: Column | str) -> Column:
    """Bigrams with their count so far: a set that stands for the multiset."""
    return F.element_at(F.transform(F.array(bigrams(c(x))), lambda g: F.transform(g, lambda e, i: F.concat(e, F.size(F.filter(F.slice(g, 1, i), lambda o: o == e)).cast("string")))), 1)


def dice_of(a: Column | str, a_grams: Column | str, b: Column | str, b_grams: Column | str) -> Column:
    """dice of two texts whose numbered bigrams are at hand."""
    a, b = c(a), c(b)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * F.size(F.array_intersect(c(a_grams), c(b_grams))) / (F.length(a) + F.length(b) - 2))


def private_address(url: Column | str) -> Column:
    """Whether a URL's host is local or in a blocked range."""
    host = F.lower(F.regexp_extract(c(url), "^[a-zA-Z]+://([^/?#:]+)", 1))
    return host.rlike("^(localhost|.*[.]local|.*[.]internal|0[.].*|10[.].*|127[.].*|169[.]254[.].*|192[.]168[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.].*)$")


def words(x: Column, longer: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) > longer))


def near_duplicate_fact(a: Column | str, b: Column | str) -> Column:
    """Shared words of over three letters, as a share of the smaller set, of 0.72 at least."""
    x, y = words(c(a)), words(c(b))
    least = F.least(F.size(x), F.size(y))
    return (least > 0) & (F.size(F.array_intersect(x, y)) / least >= 0.72)


def names_roughly_match(a: Column | str, b: Column | str) -> Column:
    """Whether two words of the first name are in the second, or its only one. Single letters don't count, and a name without words matches none."""
    x, y = (F.filter(F.split(fold_name(n), " "), lambda w: F.length(w) >= 2) for n in (a, b))
    shared = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    return (F.size(x) > 0) & (F.size(y) > 0) & (shared >= F.least(F.lit(2), F.size(x)))


def entropy_breadth(shares: Column | str) -> Column:
    """Entropy of a map's values over ln(min(8, n)); 0.2 for a single one, 0 for none."""
    v = F.filter(F.map_values(c(shares)), lambda x: x > 0)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(v, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))
    return F.when(F.size(v) == 0, 0.0).when(F.size(v) == 1, 0.2).otherwise(clamp(h / F.log(F.least(F.lit(8), F.size(v)))))


def term_match(text: Column | str, terms: list[str]) -> Column:
    """Whether any term occurs as whole words, whatever the case."""
    return c(text).rlike("(?iu)(?<![\\p{L}\\p{N}])(" + "|".join(map(re.escape, terms)) + ")(?![\\p{L}\\p{N}])")


def human_name(x: Column | str) -> Column:
    """Two to seven words that begin with a letter of either case but no digit."""
    w = F.split(F.trim(c(x)), " +")
    return F.size(w).between(2, 7) & F.forall(w, lambda t: t.rlike("^\\p{L}[\\p{L}.'-]*$"))


def first_sentence(x: Column | str, most: int) -> Column:
    """The first sentence without markdown marks, cut at a word with an ellipsis."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c(x), "[*_`#>]+", ""), "[ \\n\\t]+", " "))
    first = F.regexp_extract(bare, "^(.*?[.!?])( |$)", 1)
    one = F.when(first != "", first).otherwise(bare)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.substring(one, 1, most - 1), " [^ ]*$", ""), F.lit("…")))


def account_claim(url: Column | str) -> Column:
    """struct(provider, handle) that a profile URL claims; null for pages that are no profile."""
    host, path = host_of(url), F.regexp_extract(c(url), "^[a-zA-Z]+://[^/?#]+/([^?#]*)", 1)
    one = F.lower(F.regexp_extract(path, "^([A-Za-z0-9_.-]+)/?$", 1))
    reserved = one.isin("login", "signup", "search", "about", "explore", "share", "home", "settings", "intent", "topics")
    plain = {"github.com": "github", "gitlab.com": "gitlab", "x.com": "x", "twitter.com": "x", "huggingface.co": "hugging-face"}
    made = [F.when((host == h) & (one != "") & ~reserved, F.struct(F.lit(p).alias("provider"), one.alias("handle"))) for h, p in plain.items()]
    linked = F.lower(F.regexp_extract(path, "^in/([A-Za-z0-9%_-]+)/?$", 1))
    made.append(F.when((host == "linkedin.com") & (linked != ""), F.struct(F.lit("linkedin-manual").alias("provider"), linked.alias("handle"))))
    hn = F.regexp_extract(c(url), "[?&]id=([A-Za-z0-9_-]+)", 1)
    made.append(F.when((host == "news.ycombinator.com") & path.startswith("user") & (hn != ""), F.struct(F.lit("hacker-news").alias("provider"), hn.alias("handle"))))
    return F.coalesce(*made)
