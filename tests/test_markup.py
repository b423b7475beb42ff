"""The element table on small pages: malformed, nested, quoted and unquoted, against what a reader would say."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import markup
from tidemark.operators.markup import attribute, has_class, parsed


def shape(page):
    """Tags and texts as nested lists, by the open and close numbers alone."""
    root, stack = [], []
    for first, last, _, _, tag, _, text in sorted(parsed(page)):
        while stack and stack[-1][0] < first:
            stack.pop()
        into = stack[-1][1] if stack else root
        if tag.startswith("#"):
            into.append(text.strip())
        else:
            own = [tag]
            into.append(own)
            stack.append((last, own))
    return root


@pytest.mark.parametrize(("page", "want"), [
    ("<div><p>one<p>two</div>three", [["div", ["p", "one"], ["p", "two"]], "three"]),
    ("<p><b>x<br><p>y</p>", [["p", ["b", "x", ["br"]]], ["p", "y"]]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", [["ul", ["li", "a", ["ul", ["li", "b"], ["li", "c"]]], ["li", "d"]]]),
    ("<table><tr><td>1<td>2<tr><th>3</table>", [["table", ["tr", ["td", "1"], ["td", "2"]], ["tr", ["th", "3"]]]]),
    ("</i>a</p><i>b", ["a", ["i", "b"]]),
    ("<A HREF=x>y</a >", [["a", "y"]]),
    ("a < b <3 & &amp; &lt;i&gt;", ["a", "<", "b", "<", "3 & & <i>"]),
    ("<script>if (a<b) '</p>'</script><p>x", [["script", "if (a<b) '</p>'"], ["p", "x"]]),
    ("<title>a &amp; <b></title>z", [["title", "a & <b>"], "z"]),
    ("<!-- <p> --><!DOCTYPE html><?x y?>t", ["t"]),
    ("<b><i>x</b>y</i>", [["b", ["i", "x"]], "y"]),
    ("<style>p{", [["style", "p{"]]),
    ("", []),
    ("<!-- open", []),
])
def test_trees_of_odd_pages(page, want):
    assert shape(page) == want


def test_attributes():
    page = """<input id=a data-x='1 > 0' title="say &quot;hi&quot;" checked CLASS = "b  c" id=second href=/x?y=1&amp;z=2>"""
    assert dict(parsed(page)[0][5]) == {"id": "a", "data-x": "1 > 0", "title": 'say "hi"', "checked": "", "class": "b  c", "href": "/x?y=1&z=2"}


def test_numbers_nest_and_depths_follow_from_them():
    rng = random.Random(2)
    for _ in range(50):
        page = "".join(rng.choice(["<p>", "</p>", "<div a=1>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<br>", "x ", "<td>", "<tr>", "<"]) for _ in range(60))
        found = sorted(parsed(page))
        spans = {f[0]: f[1] for f in found}
        for first, last, depth, parent, *_ in found:
            around = [o for o, c in spans.items() if o < first and c > last]
            assert len(around) == depth and max(around, default=0) == parent
            assert all(c < first or o > last or (o < first and c > last) or (o >= first and c <= last) for o, c in spans.items())


def test_deep_and_long_pages_take_time_in_proportion():
    deep = parsed("<b>" * 50_000 + "</i>" * 50_000 + "x")
    assert len(deep) == 50_001 and max(f[2] for f in deep) == 50_000
    assert len(parsed('<a title="x>' * 20_001)) < 20_002


@pytest.fixture(scope="module")
def found(spark):
    pages = [(1, "<div class='row x' id=r1><span class=n>A <b>b</b></span><i class='fa on'></i><div class=row id=r2><span class=n>C</span></div><a href=/1>one</a><a>two</a></div><p>out"), (2, None), (3, ""), (4, "<div class=row id=r3></div>")]
    return markup.elements(spark.createDataFrame(pages, "k int, html string"), "html", ["k"]).cache()


def test_inside_gives_the_innermost_or_outermost(found):
    rows = found.filter(has_class("row"))
    for outermost, want in ((False, {"A": "r1", "b": "r1", "C": "r2", "one": "r1", "two": "r1", "out": None}), (True, {"A": "r1", "b": "r1", "C": "r1", "one": "r1", "two": "r1", "out": None})):
        got = markup.inside(found.filter("tag = '#text'"), rows, ["k"], outermost)
        names = {(r["k"], r["open"]): r["id"] for r in rows.select("k", "open", attribute("id").alias("id")).collect()}
        assert {r["text"].strip(): names.get((r["k"], r["within"])) for r in got.collect()} == want
    own = markup.inside(rows, rows, ["k"])
    assert [r["within"] is None for r in own.orderBy("k", "open").collect()] == [True, False, True]


def test_records_take_the_first_that_fits(found):
    fields = {"name": (has_class("n"), None), "on": (has_class("on"), F.lit("1")), "link": (F.col("tag") == "a", attribute("href")), "said": (F.col("tag") == "a", None), "bold": (F.col("tag") == "b", None)}
    got = {r["attributes"]["id"]: (r["name"], r["on"], r["link"], r["said"], r["bold"]) for r in markup.records(found, has_class("row"), fields, ["k"]).collect()}
    assert got == {"r1": ("A b", "1", "/1", "one", "b"), "r2": ("C", None, None, None, None), "r3": (None, None, None, None, None)}


def test_items_are_in_order(found):
    got = markup.items(found, has_class("row"), F.col("tag") == "a", ["k"]).orderBy("place").collect()
    assert [(r["place"], r["words"], r["attributes"].get("href")) for r in got] == [(0, "one", "/1"), (1, "two", None)]


def test_arguments_of_a_call(spark):
    df = spark.createDataFrame([("playPosition(this, { cue: '2735',idPlayer: '', cue : '3' } );",), ("none",), (None,)], "c string")
    assert [r[0] for r in df.select(markup.arguments(F.col("c"))).collect()] == [{"cue": "3", "idPlayer": ""}, {}, None]


def test_nothing_of_nothing(spark):
    empty = markup.elements(spark.createDataFrame([], "k int, html string"), "html", ["k"])
    assert markup.texts(empty, empty, ["k"]).count() == 0
    assert markup.records(empty, has_class("row"), {"n": (has_class("n"), None)}, ["k"]).count() == 0


@pytest.mark.parametrize("batch", [7, 10_000])
def test_page_records_are_those_of_the_element_table(spark, batch):
    draw = random.Random(6)
    piece = lambda: draw.choice(["<div class=row>", "<div class='row n'>", "</div>", "<span class=n>", "</span>", "<i class=on>", "<a href=/x>", "<a>", "</a>", "<b>", "</b>", "   ", "w", "x y"])
    pages = spark.createDataFrame([(k, "".join(piece() for _ in range(draw.randrange(40)))) for k in range(150)] + [(997, None), (998, ""), (999, "<div class=row>" + "<b>z</b>" * 30)], "k int, html string")
    fields = {"name": (has_class("n"), None), "on": (has_class("on"), F.lit("1")), "link": (F.col("tag") == "a", attribute("href")), "said": (F.col("tag") == "a", None), "bold": (F.col("tag") == "b", None)}
    plain = lambda df: sorted(((r["k"], r["open"], r["attributes"]["class"], *(r[f] or "" for f in fields)) for r in df.collect()))
    want = plain(markup.records(markup.elements(pages, "html", ["k"]), has_class("row"), fields, ["k"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert plain(markup.page_records(pages, "html", has_class("row"), fields, ["k"])) == want and len(want) > 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = markup.page_records(pages, "html", has_class("row"), fields, ["k"])
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # elements aren't moved


@pytest.mark.parametrize("known", [0, 4_096])
def test_records_read_where_a_page_is_parsed_are_those_of_the_element_table(spark, monkeypatch, known):
    """Odd pages: nested rows and fields, rows that are fields, repeated classes, missing attributes, empty texts, raw content."""
    monkeypatch.setattr(markup, "_KNOWN", known)
    draw = random.Random(9)
    pieces = ["<div class=row>", "<DIV class='row n' id=a1>", "</div>", "<span class='n  n'>", "</span>", "<i class=on>", "<i>", "<a href=/x id=\"b1\">", "<a>", "</a>", "<b id=a&amp;>", "</b>", "   ", "w", "x &amp; y", "&nbsp;", "<script>a<b class=n></script>", "<br class=on id=a2>", "<p class=n>"]
    pages = spark.createDataFrame([(k, "".join(draw.choices(pieces, k=draw.randrange(40)))) for k in range(300)] + [(997, None), (998, ""), (999, "<div class=row>" + "<b>z</b>" * 30)], "k int, html string")
    by_id = F.coalesce(attribute("id").rlike("^a"), F.lit(False))
    columns = {"name": (has_class("n"), None), "on": (has_class("on"), attribute("id")), "link": (F.col("tag") == "a", attribute("href")), "said": (F.col("tag") == "a", None), "bold": ((F.col("tag") == "b") & by_id, None), "any": (by_id, attribute("class")), "both": (has_class("n") & (F.col("tag") == "span"), attribute("class"))}
    fields = {"name": markup.Field(of_class="n"), "on": markup.Field(of_class="on", value="id"), "link": markup.Field("a", value="href"), "said": markup.Field("a"), "bold": markup.Field("b", like=("id", "^a")), "any": markup.Field(like=("id", "^a"), value="class"), "both": markup.Field("span", "n", value="class")}
    plain = lambda df: sorted((r["k"], r["open"], sorted(r["attributes"].items()), *(r[f] or "" for f in fields)) for r in df.collect())
    want = plain(markup.page_records(pages, "html", has_class("row"), columns, ["k"]))
    assert want == plain(markup.records(markup.elements(pages, "html", ["k"]), has_class("row"), columns, ["k"])) and len(want) > 300
    assert plain(markup.parsed_records(pages, "html", markup.Field(of_class="row"), fields, ["k"])) == want


def test_elements_of_track_rows_are_not_rows_of_a_table(spark, sf_dir):
    """Sixteen elements a page would go to Spark for their conditions and back to Python; nor is markup shuffled."""
    from tidemark.plans import pages

    plan = pages.track_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "<div" in plan[: plan.index("Exchange")] and "<div" not in plan[plan.index("Exchange") :]
