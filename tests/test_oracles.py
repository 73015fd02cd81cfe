"""Every registered query of the plans against its SQL, and the plan shapes that matter."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog
from tessera.plans.bindings import view
from tessera.operators import scoring


def normal(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return None
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return round(float(x), 5) + 0.0
        if hasattr(x, "dtype") and x.dtype.kind in "iub":
            return float(x)
        return float(x) if isinstance(x, (int, bool)) else str(x)

    cols = sorted(df.columns)
    return sorted((tuple(map(cell, r)) for r in df[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.sql(f"create view {t.split('.')[0]} as select * from '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_scores_have_no_python_and_no_nested_loop(spark, data):
    plan = scoring.score(view(spark, data, "evidence"), "person_id", "2024-01-31 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "Expand" not in plan


def test_row_order_does_not_matter(spark, data):
    e = view(spark, data, "evidence")
    a = scoring.score(e, "person_id", "2024-01-31 00:00:00").select("person_id", "total").toPandas()
    b = scoring.score(e.repartition(7, "event_id"), "person_id", "2024-01-31 00:00:00").select("person_id", "total").toPandas()
    assert normal(a) == normal(b)


def test_titles_with_references_equal_their_sql(spark, tmp_path):
    """Named and numeric references of all forms, cut ones, and those that look like two."""
    titles = ["a &amp; b", "a &amp", "&ampx; &amp;lt; &lt &quot;q&quot;", "&notin; &notit; &not", "&#65;&#x42&#x43; &#0; &#128; &#x110000; &#xD800; &#11; &#99999999999; &#; &#x; &#xg", "\u00a0&nbsp; x\t\n&nbsp;", "&CounterClockwiseContourIntegral; &zzz; &", "&&amp&amp;&", "&lbrace;&NotEqualTilde;", ""]
    rows = [(i, "u", f"<html><title>{t}</title><body>x</body></html>") for i, t in enumerate(titles)] + [(50, "u", None), (51, "u", "no title"), (51, "u", "no title"), (None, "u", "<title>&eacute;</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["s17_owned_page_profile"](spark, str(tmp_path)).toPandas()
    assert normal(got) == normal(c.sql(catalog.ORACLES["s17_owned_page_profile"]).df())
