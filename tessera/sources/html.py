"""Passes over HTML that need a parser: rosters, structured data, owned profiles. Each is one partition-wise map."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import account_claim, human_name, medal, placement, redact_contact
from tessera.functions.store import ship
from tessera.operators.windows import cap_per_group, first_of


class _Rows(HTMLParser):
    """Cells of table rows, with the first link of each row; JSON-LD scripts; rel=me and plain anchors; title and description."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell, self.href = [], None, None, None
        self.scripts, self.script, self.anchors, self.title, self.in_title, self.description = [], None, [], "", False, ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.row, self.href = [], None
        elif tag in ("td", "th") and self.row is not None:
            self.cell = ""
        elif tag == "a" and a.get("href"):
            self.anchors.append((a["href"], "rel-me" if "me" in (a.get("rel") or "").split() else "profile-link"))
            if self.row is not None and self.href is None:
                self.href = a["href"]
        elif tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.script = ""
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description"):
            self.description = self.description or (a.get("content") or "")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(re.sub(r"\s+", " ", self.cell).strip())
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append((self.row, self.href))
            self.row = None
        elif tag == "script" and self.script is not None:
            self.scripts.append(self.script)
            self.script = None
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data
        if self.script is not None:
            self.script += data
        if self.in_title:
            self.title += data


def parse(html: str | None) -> _Rows:
    p = _Rows()
    p.feed(html or "")
    p.close()
    return p


def nodes_of(scripts: list[str], most: int = 80) -> list[dict]:
    """JSON-LD nodes, graphs flattened; broken scripts give none."""
    out: list[dict] = []
    for s in scripts:
        try:
            found = json.loads(s)
        except ValueError:
            continue
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                out += [n for n in x.get("@graph", [x]) if isinstance(n, dict)]
    return out[:most]


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, line, cells, href of every table row."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, k, cells, href) for i, html in zip(f["page_id"], f["html"], strict=True) for k, (cells, href) in enumerate(parse(html).rows)], columns=["page_id", "line", "cells", "href"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, line int, cells array<string>, href string")


def extract_roster(pages: DataFrame) -> DataFrame:
    """name, profile_url, affiliation, rank, recognition of table rows under a labelled person column; the first of equal names and URLs stays."""
    from pyspark.sql.window import Window

    lines = table_rows(pages)
    head = F.exists("cells", lambda x: F.lower(x).isin("name", "contestant", "participant", "winner", "student"))
    w = Window.partitionBy("page_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("head", F.last(F.when(head, F.transform("cells", F.lower)), ignorenulls=True).over(w)).filter(~head & F.col("head").isNotNull())
    cell = lambda *names: F.coalesce(*[F.get("cells", F.array_position("head", n).cast("int") - 1) for n in names])
    award = cell("award", "medal")
    out = x.select("page_id", "line", cell("name", "contestant", "participant", "winner", "student").alias("name"), F.col("href").alias("profile_url"), cell("country", "school", "affiliation").alias("affiliation"), placement(cell("rank", "place")).alias("rank"), F.regexp_replace(medal(award), " medal$", "").alias("recognition"))
    return first_of(out.filter(human_name("name")), ["page_id", "name", "profile_url"], [F.asc("line")])


def page_nodes(pages: DataFrame) -> DataFrame:
    """page_id, kind, name, url, published of JSON-LD articles, projects and persons."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, html in zip(f["page_id"], f["html"], strict=True):
                for n in nodes_of(parse(html).scripts):
                    kind = n.get("@type")
                    kind = kind[0] if isinstance(kind, list) and kind else kind
                    if kind in ("Article", "BlogPosting", "NewsArticle", "SoftwareSourceCode", "CreativeWork", "Person"):
                        out.append((i, kind, n.get("headline") or n.get("name"), n.get("url"), n.get("datePublished")))
            yield pd.DataFrame(out, columns=["page_id", "kind", "name", "url", "published"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, kind string, name string, url string, published string")


def cross_profile_claims(pages: DataFrame, most: int = 12) -> DataFrame:
    """page_id, provider, handle, proof: profiles that a page's anchors, rel=me links and sameAs lists claim, the strongest proof of each, in order."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, html in zip(f["page_id"], f["html"], strict=True):
                p = parse(html)
                same = [(u, "jsonld-same-as") for n in nodes_of(p.scripts) for u in (n.get("sameAs") if isinstance(n.get("sameAs"), list) else [n.get("sameAs")]) if isinstance(u, str)]
                out += [(i, k, u, proof) for k, (u, proof) in enumerate(p.anchors + same)]
            yield pd.DataFrame(out, columns=["page_id", "line", "url", "proof"])

    ship(pages.sparkSession)
    links = pages.select("page_id", "html").mapInPandas(rows, "page_id long, line int, url string, proof string")
    x = links.withColumn("claim", account_claim("url")).filter("claim IS NOT NULL").select("page_id", "line", "claim.*", "proof")
    strength = F.when(F.col("proof") == "rel-me", 0).when(F.col("proof") == "jsonld-same-as", 1).otherwise(2)
    one = first_of(x, ["page_id", "provider", "handle"], [strength, F.asc("line")])
    return cap_per_group(one, ["page_id"], [F.asc("line")], most)


def owned_page_profile(pages: DataFrame) -> DataFrame:
    """page_id, title, description (contacts redacted), content_hash."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "title": [p.title.strip() for p in parsed], "description": [p.description for p in parsed], "html": f["html"]})

    ship(pages.sparkSession)
    x = pages.select("page_id", "html").mapInPandas(rows, "page_id long, title string, description string, html string")
    return x.select("page_id", "title", redact_contact("description").alias("description"), F.sha2("html", 256).alias("content_hash"))
