from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from citetrust.fixtures.suffixes import SHORT_SUFFIXES
from citetrust.functions import text as t


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


C = "text"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a {{Disputed}} b", True),
        ("a {{dISPUTED|date=May}} b", True),
        ("{{Disputed inline}}", False),
        ("{{ Disputed}}", False),
        ("{{Disputed\n|x}}", False),
        ("{{disputed inline}} and {{disputed}}", True),
        ("", False),
        (None, False),
    ],
)
def test_template_present(spark, text, expected):
    assert one(spark, t.template_present(F.col(C), "Disputed"), text) is expected


def test_template_name_is_taken_literally(spark):
    column = t.template_present(F.col(C), "Unreliable source?")
    assert one(spark, column, "x {{unreliable source?|y}}") is True
    assert one(spark, column, "x {{unreliable sourc}}") is False


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<ref>http://www.badsite.com</ref>", ["badsite.com"]),
        ("<REF name='a'>see https://a.org/x and http://b.net ok</Ref>", ["a.org", "b.net"]),
        ("<ref>http://a.org</ref> <ref>http://a.org/2</ref>", ["a.org", "a.org"]),
        # Only the plain form is looked into.
        ("&lt;ref&gt;http://a.org&lt;/ref&gt;", []),
        # A ref over several lines is missed.
        ("<ref>\nhttp://a.org</ref>", []),
        # A self-closing ref takes everything up to the next end of a ref.
        ('<ref name="x"/> http://a.org <ref>http://b.org</ref>', ["a.org", "b.org"]),
        ("<references/> http://a.org", []),
        # A trailing bracket stays, as does a pipe.
        ("<ref>(http://foo.com)</ref>", ["foo.com)"]),
        ("<ref>{{cite web|url=http://a.com|title=x}}</ref>", ["a.com|title=x"]),
        ("<ref>[http://a.com text]</ref>", ["a.com"]),
        ("<ref>http://a.com]]</ref>", ["a.com"]),
        (None, []),
    ],
)
def test_ref_urls(spark, text, expected):
    assert one(spark, t.ref_urls(F.col(C), SHORT_SUFFIXES), text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("{{cite web|url=http://a.com/x|title=y}}", ["a.com"]),
        ("{{Citation | URL = http://www.b.org }}", ["b.org"]),
        ("{{cite web|archiveurl=http://old.net/1|url=http://a.com}}", ["old.net"]),
        ("{{vcite2 journal|url=http://c.ac.uk}} {{wayback|url=http://d.com}}", ["c.ac.uk", "d.com"]),
        ("{{infobox|url=http://a.com}}", []),
        ("{{cite web|url=|title=x}}", []),
        ("{{cite\nweb|url=http://a.com\n|title=x}}", ["a.com"]),
    ],
)
def test_cite_urls(spark, text, expected):
    assert one(spark, t.cite_urls(F.col(C), SHORT_SUFFIXES), text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("{{cite book|isbn=0-684-18241-3}}", ["ISBN:0684182413"]),
        ("{{cite book|ISBN = 0 8044 2957 X }}", ["ISBN:080442957X"]),
        ("{{cite book|isbn=080442957x}}", ["ISBN:080442957"]),
        ("{{cite book|isbn=none}}", []),
        ("{{cite book|title=x}}", []),
        ("isbn=123", []),
    ],
)
def test_isbns(spark, text, expected):
    assert one(spark, t.isbns(F.col(C)), text) == expected


def test_extract_sources_order_and_distinct(spark):
    text = (
        "<ref>http://z.org</ref> {{cite book|isbn=1|url=http://b.org}} "
        "<ref>{{cite web|url=http://a.org }}</ref> <ref>http://z.org/2</ref> {{cite x|isbn=2}}"
    )
    found = one(spark, t.extract_sources(F.col(C), SHORT_SUFFIXES), text)
    assert found == ["z.org", "a.org", "b.org", "ISBN:1", "ISBN:2"]
    assert one(spark, t.extract_sources(F.col(C), SHORT_SUFFIXES), None) == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<ref>http://a.org/x</ref>{{Bad source}}", ["a.org"]),
        ("<ref name=q>http://a.org</ref> \n {{bad source|date=1}}", ["a.org"]),
        ("&lt;ref&gt;http://e.org&lt;/ref&gt;{{Bad source}}", ["e.org"]),
        ("<ref>http://a.org</ref>{{Bad source list}}", ["a.org"]),
        # Only a bare URL is a source.
        ("<ref>see http://a.org</ref>{{Bad source}}", []),
        # An earlier ref on the same line is swallowed, and the source with it.
        ("<ref>x</ref> <ref>http://a.org</ref>{{Bad source}}", []),
        ("<ref>x</ref>\n<ref>http://a.org</ref>{{Bad source}}", ["a.org"]),
        ("<ref>http://a.org</ref> text {{Bad source}}", []),
        (
            "<ref>http://a.org</ref>{{Bad source}}\n<ref>http://b.org</ref>{{Bad source}}"
            "\n<ref>http://a.org/2</ref>{{Bad source}}",
            ["a.org", "b.org"],
        ),
        (None, []),
    ],
)
def test_inline_sources(spark, text, expected):
    assert one(spark, t.inline_sources(F.col(C), "Bad source", SHORT_SUFFIXES), text) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        ("foo.com)", "foo.com"),
        ("a.com|title=x", "a.com"),
        ("[a].{b}(c)", "a.bc"),
        ("|", ""),
        ("a.com", "a.com"),
    ],
)
def test_cleanup_source(spark, source, expected):
    assert one(spark, t.cleanup_source(F.col(C)), source) == expected


def test_template_slug():
    assert t.template_slug("Unreliable Source") == "unreliable-source"


def plain_domain(url):
    """Registrable domain in plain Python, for hosts below the few suffixes used here."""
    url = re.sub(r"(\}\}|\]\])$", "", url.strip()).strip()
    match = re.match(r"https?://([^/?#:@]*)(:[0-9]*)?([/?#]|$)", url)
    if not match or "{{" in url:
        return None
    labels = match.group(1).lower().split(".")
    n = 2 if labels[-2:] in (["co", "uk"], ["ac", "at"]) else 1
    return ".".join(labels[-n - 1 :]) if len(labels) > n and "" not in labels else None


def plain_sources(text):
    found = []
    for ref in re.findall(t.REF, text):
        found += [plain_domain(u) for u in re.findall(t.URL, ref[0])]
    for cite in re.finditer(t.CITE.replace("(?i)", ""), text, re.IGNORECASE):
        url, isbn = re.search(t.URL_FIELD, cite[0]), re.search(t.ISBN_FIELD, cite[0])
        found.append(plain_domain(url[1]) if url else None)
        digits = re.sub(t.NOT_ISBN, "", isbn[1]) if isbn else ""
        found.append(f"ISBN:{digits}" if digits else None)
    return list(dict.fromkeys(s for s in found if s))


def test_random_texts(spark):
    """Fragments thrown together, against the same patterns run by Python."""
    rng = random.Random(11)
    urls = ["http://a.org", "https://www.B.co.uk/x?y=1", "http://c.ac.at:80", "http://d..com", "http://e"]
    ends = ["", "/", ")", "]]", "}}", "|x", " ", "}}}}", "{{x", "#f"]
    fragments = ["<ref>", "<ref name=q>", "</ref>", "<REF/>", "{{cite web|", "{{Citation |", "}}", "|"]
    fragments += ["url=", "URL = ", "|isbn=97-8X x", "|isbn= 12", "\n", " ", "text", "&lt;ref&gt;"]
    texts = []
    for _ in range(1500):
        parts = []
        for _ in range(rng.randint(1, 25)):
            link = rng.choice(urls) + rng.choice(ends)
            whole = [link, f"<ref>{link}</ref>", f"{{{{cite web|url={link}|isbn=1X{len(parts)}}}}}"]
            parts.append(rng.choice(whole) if rng.random() < 0.35 else rng.choice(fragments))
        texts.append("".join(parts))
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    rows = df.select("text", t.extract_sources(F.col(C), SHORT_SUFFIXES).alias("src")).collect()
    wrong = [(r.text, r.src, plain_sources(r.text)) for r in rows if r.src != plain_sources(r.text)]
    assert not wrong, wrong[:3]
    assert sum(len(r.src) for r in rows) > 1000
