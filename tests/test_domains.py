from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citetrust.fixtures.suffixes import SHORT_SUFFIXES
from citetrust.functions.domains import load_suffixes, url_domains


def domains(spark, urls, suffixes=SHORT_SUFFIXES):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    found = F.get(url_domains(F.array("url"), suffixes), F.lit(0))
    return dict(df.select("url", found.alias("d")).collect())


CASES = {
    "http://www.mdw.ac.at/x": "mdw.ac.at",
    "https://maths.unsw.edu.au": "unsw.edu.au",
    "http://antiquity.ac.uk/ant/1": "antiquity.ac.uk",
    "http://WWW.LUGNET.com/": "lugnet.com",
    "HTTP://a.b.com": "b.com",
    "ftp://files.x.org/": "x.org",
    "gopher://x.org/": None,
    "x.org": None,
    "http://": None,
    "": None,
    "  http://a.com  ": "a.com",
    "http://a.com}}": "a.com",
    "http://a.com ]] ": "a.com",
    "http://a.com}}}}": "a.com}}",
    "http://a.com}": "a.com}",
    "http://a.com)": "a.com)",
    "http://a.com,": "a.com,",
    "http://a.com|title=x": "a.com|title=x",
    "http://a.com/{{dead link}}": None,
    "http://user:pw@a.com:8080/x?y": "a.com",
    "http://a@b@c.com/": None,
    "http://a.com:8x/": None,
    "http://a.com?q=1": "a.com",
    "http://a.com#f": "a.com",
    "http://a.com/x@y": "a.com",
    "http://co.uk/": None,
    "http://com/": None,
    "http://localhost/": None,
    "http://a.b.c.co.uk/": "c.co.uk",
    "http://x.y.foo.ck": "y.foo.ck",
    "http://foo.ck": None,
    "http://www.ck": "www.ck",
    "http://sub.www.ck": "www.ck",
    "http://a.school.town.sch.uk/": "school.town.sch.uk",
    "http://a..com/": None,
    "http://.com/": None,
    "http://a.com./": None,
    "http://unknown.newtld": "unknown.newtld",
}


def test_registrable_domain(spark):
    assert domains(spark, list(CASES)) == CASES


def test_null_url(spark):
    assert domains(spark, [None]) == {None: None}


def test_longest_rule_wins_and_names_are_quoted(spark):
    rules = ("com", "b.com", "a.b.com", "it's.net")
    urls = {"http://x.y.a.b.com": "y.a.b.com", "http://q.it's.net/": "q.it's.net"}
    assert domains(spark, list(urls), rules) == urls


def test_rules_from_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// comment\n\ncom\n  co.uk \n*.ck // note\n!www.ck\n")
    assert load_suffixes(spark, str(path)) == ("com", "co.uk", "*.ck", "!www.ck")


def test_rules_have_to_be_given(spark):
    with pytest.raises(ValueError, match="no suffix rules"):
        url_domains(F.array(F.lit("http://a.com")), [])
