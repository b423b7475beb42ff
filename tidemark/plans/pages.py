"""Pages and rows of markup as element tables, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import markup
from ..operators.markup import Field, attribute, has_class
from ..operators.streams import dealt
from ..sources.tables import table, written

KEY = ["page_id"]


def page_elements(spark: SparkSession, d: str) -> DataFrame:
    return markup.elements(table(spark, d, "pages"), "html", KEY)


def element_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each page by tag, and how many have attributes."""
    found = page_elements(spark, d).filter("tag NOT LIKE '#%'")
    return found.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("attributes") > 0).alias("attributed"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Each link of a page with its place, target and text."""
    found = written(page_elements(spark, d).filter("tag IN ('html', 'a', '#text')"))
    every = markup.items(found, F.col("tag") == "html", (F.col("tag") == "a") & attribute("href").isNotNull(), KEY)
    return every.select("page_id", "place", attribute("href").alias("href"), F.col("words").alias("label"))


def html_row_tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of a page as rows: place, characters of the plain text, and whether it has markup inside; one without end ends where the next begins."""
    found = written(page_elements(spark, d))
    rows = markup.items(found, F.col("tag") == "article", F.col("tag") == "p", KEY)
    inner = markup.inside(found.filter("tag NOT LIKE '#%'"), found.filter("tag = 'p'"), KEY).filter("within IS NOT NULL")
    marked = inner.select("page_id", F.col("within").alias("open"), F.lit(1).alias("marked")).distinct()
    rows = rows.join(marked, ["page_id", "open"], "left")
    return rows.select("page_id", "place", F.length("words").alias("n"), F.coalesce("marked", F.lit(0)).alias("marked"))


def embedded_array_extract(spark: SparkSession, d: str) -> DataFrame:
    """The arguments of the calls in a page's scripts, read as a JSON array: the function, how many and the first."""
    call = F.explode(F.regexp_extract_all("text", F.lit(r"(\w+\([^()]*\))"), F.lit(1))).alias("call")
    calls = page_elements(spark, d).filter("tag = '#script'").select("page_id", call)
    given = F.from_json(F.concat(F.lit("["), F.regexp_extract("call", r"\(([^()]*)\)", 1), F.lit("]")), "array<bigint>")
    return calls.select("page_id", F.regexp_extract("call", r"^\w+", 0).alias("called"), F.size(given).alias("n"), F.get(given, F.lit(0)).alias("first"))


def nav_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of each page's navigation: place, target and words of the link in it, and how deep the item lies under the navigation."""
    found = written(page_elements(spark, d))
    nav = found.filter("tag = 'nav'").select("page_id", F.col("open").alias("of_row"), F.col("depth").alias("top"))
    rows = markup.items(found, F.col("tag") == "nav", F.col("tag") == "li", KEY)
    links = markup.records(found, F.col("tag") == "li", {"href": (F.col("tag") == "a", attribute("href")), "label": (F.col("tag") == "a", None)}, KEY)
    rows = rows.join(links.drop("attributes"), ["page_id", "open"]).join(found.select("page_id", "open", "depth"), ["page_id", "open"]).join(nav, ["page_id", "of_row"])
    return rows.select("page_id", "place", "href", "label", (F.col("depth") - F.col("top")).alias("below"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def _joined(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def track_markup(spark: SparkSession, d: str) -> DataFrame:
    """row_id, html: orders as rows of a track list, with quoted, unquoted and single-quoted attributes, upper-case tags and ends left out."""
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    together = F.when(priority.startswith("1"), F.lit(" con")).otherwise(F.lit(""))
    number = F.when(priority.startswith("2"), F.lit("w/")).otherwise((k % 100).cast("string"))
    name = _escaped(F.concat(F.col("c_name"), F.lit(" & \"Co\" - "), F.lower(priority), F.lit(" (Live Mix)")))
    seconds = k % 7000
    play = _joined("<DIV class=bPlay><input type='hidden' id=\"tlp_", k, '_cue_seconds" value=', seconds, "><span id='tlp_", k, "_tracknumber_value'> ", number, "\n</span><div class='cue  mono' id=cue_", k, ">", times.timecode(seconds), "</div></DIV>")
    title = _joined('<div itemtype="http://schema.org/MusicRecording"><meta itemprop="name" content="', name, '"><meta content=PT', F.floor(k % 600 / 60), "M", k % 60, "S itemprop=duration><span class='blue trackValue'><b>", _escaped(F.concat(F.col("c_name"), F.lit(' & "Co"'))), "</b> - ", F.lower(priority), "&nbsp; (Live Mix)</span></div>")
    media = _joined("<div class='mediaRow' data-trackid=", F.col("o_custkey"), F.when(status == "P", F.lit(" data-remix='1'")).otherwise(F.lit("")), '><i class="fa fa-spotify">', F.when(status == "O", F.lit("</i><i class='fa fa-apple'></i>")).otherwise(F.lit("")), "<!-- </div> --></div>")
    row = _joined('<div class="tlpTog tlpItem', together, "\" id='tlp_", k, "' data-id=", k, " data-isided=\"", (status == "F").cast("string"), '">', play, title, media, "</div>")
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    # Dealt as columns: as markup they are ten times as long.
    return dealt(orders.select(k, "o_custkey", status, priority, "c_name"), "o_orderkey").select(k.alias("row_id"), row.alias("html"))


def track_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a track list as structs: ids, flags, cue, names and media."""
    fields = {
        "cue_seconds": Field("input", like=("id", "_cue_seconds$"), value="value"),
        "number": Field("span", like=("id", "_tracknumber_value$")),
        "timecode": Field("div", like=("id", "^cue_")),
        "full_name": Field("meta", like=("itemprop", r"^name\Z"), value="content"),
        "duration": Field("meta", like=("itemprop", r"^duration\Z"), value="content"),
        "shown": Field("span", "trackValue"),
        "track_id": Field(of_class="mediaRow", value="data-trackid"),
        "remix": Field(of_class="mediaRow", value="data-remix"),
        "spotify": Field(of_class="fa-spotify", value="class"),
        "apple": Field(of_class="fa-apple", value="class"),
    }
    rows = markup.parsed_records(track_markup(spark, d), "html", Field(of_class="tlpItem"), fields, ["row_id"])
    parts = F.split("shown", " - ", 2)
    title = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.col("shown")), r"\s*\(.+\)\s*$", "")
    return rows.select(
        "row_id", attribute("data-id").cast("long").alias("tlp_id"), (attribute("data-isided") == "true").alias("is_ided"), (has_class("con") | F.coalesce(F.col("number") == "w/", F.lit(False))).alias("is_concurrent"),
        F.col("cue_seconds").cast("int").alias("cue_seconds"), times.timecode_seconds(F.col("timecode")).cast("int").alias("cue_time_seconds"), "full_name", times.iso_seconds(F.col("duration")).cast("int").alias("duration_seconds"),
        title.alias("title"), F.col("track_id").cast("long").alias("track_id"), F.coalesce(F.col("remix") == "1", F.lit(False)).alias("is_remix"), F.col("spotify").isNotNull().alias("spotify"), F.col("apple").isNotNull().alias("apple"),
    )


def notice_markup(spark: SparkSession, d: str) -> DataFrame:
    """row_id, html: events as notice rows of several kinds, by the number in their properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = k % 9
    user = F.col("user_id")
    body = (
        F.when(kind == 0, _joined("<i class='fa fa-exclamation-triangle'></i> Title <b>wrong</b>"))
        .when(kind == 1, _joined("see identical tracklist(s): <a href=/tracklist/", user, ">T ", user, "</a>"))
        .when(kind == 2, F.lit("New added\n video track(s)"))
        .when(kind == 3, _joined("<div class=hOO onclick=\"new UserSuggest(this, { type:'add_videotrack', idTL: '", user, "' } ).show();\">Add missing live video"))
        .when(kind == 4, _joined("<i class=\"fa fa-info-circle\">Info"))
        .when(kind == 5, _joined("<span class=fRow><a href='/dj/", user, "/'>D", user, "</a> <span>&amp;</span><a href=/dj/x/>X &lt; Y</a><span>played:</span><i class='fa fa-trash' onclick=\"del({ anker:'tlp_", F.col("event_id"), "' })\"></i></span>"))
        .when(kind == 6, _joined("<span class='breakAll big'>Stage ", user, "</span>"))
        .when(kind == 7, _joined("<a href='/tracklist/", user, "'>Set</a>: identical tracklist start"))
        .otherwise(F.lit("<p>plain <p>words"))
    )
    return table(spark, d, "events").select(F.col("event_id").alias("row_id"), _joined('<div class="bItmH', F.when(kind == 3, F.lit(" interaction")).otherwise(F.lit("")), '">', body, "</div>").alias("html"))


def notice_rows(spark: SparkSession, d: str) -> DataFrame:
    """Notice rows with their kind, words, number of links, first link and what a script call in them names."""
    key = ["row_id"]
    found = written(markup.elements(notice_markup(spark, d), "html", key))
    row = has_class("bItmH")
    linked = F.coalesce(attribute("href").contains("/tracklist/"), F.lit(False))
    fields = {
        "headline": ((F.col("tag") == "span") & has_class("breakAll"), F.lit("1")), "played": ((F.col("tag") == "span") & has_class("fRow"), F.lit("1")), "cta": ((F.col("tag") == "div") & has_class("hOO"), F.lit("1")),
        "linked": ((F.col("tag") == "a") & linked, F.lit("1")), "call": (attribute("onclick").isNotNull(), attribute("onclick")),
    }
    rows = markup.texts(found, markup.records(found, row, fields, key).join(found.select("row_id", "open", "close"), ["row_id", "open"]), key)
    inner = markup.inside(found.filter("tag IN ('a', 'i')"), found.filter(row), key).filter("within IS NOT NULL")
    lists = inner.groupBy("row_id", F.col("within").alias("open")).agg(F.flatten(F.collect_list(F.when(F.col("tag") == "i", F.split(attribute("class"), r"\s+")))).alias("icons"), F.count_if(F.col("tag") == "a").alias("links"), F.min_by(attribute("href"), F.when(F.col("tag") == "a", F.col("open"))).alias("first_link"))
    rows = rows.join(lists, ["row_id", "open"], "left").withColumn("icons", F.coalesce("icons", F.array().cast("array<string>")))
    there = lambda c: F.col(c).isNotNull()
    kind = markup.notice_kind(F.col("words"), F.col("icons"), there("headline"), there("played"), has_class("interaction") & there("cta"), there("linked"))
    given = markup.arguments(F.col("call"))
    return rows.select("row_id", kind.alias("kind"), "words", F.coalesce("links", F.lit(0)).alias("links"), "first_link", F.coalesce(F.try_element_at(given, F.lit("anker")), F.try_element_at(given, F.lit("idTL"))).alias("named"))


def linked_markup(spark: SparkSession, d: str) -> DataFrame:
    """row_id, html: the lines of an order as items linked to a row."""
    line = _joined("<div class='tlLinkItem'><span class=noWrap><a href=\"/user/", F.col("l_suppkey"), "\">U", F.col("l_suppkey"), "</a><span class=spL>", F.col("l_linenumber"), "</span></span>", F.when(F.col("l_returnflag") == "R", F.lit("<br>")).otherwise(F.lit("</div>")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("h")))).alias("lines"))
    return lines.select(F.col("l_orderkey").alias("row_id"), _joined("<div class=tlpItem data-isid=true><div class='tgHid'>", F.array_join(F.transform("lines", lambda x: x["h"]), "\n"), "</div>").alias("html"))


def linked_items(spark: SparkSession, d: str) -> DataFrame:
    """Rows with what is linked to them, in order, as a text of user and followers; an item may lack its end."""
    key = ["row_id"]
    user = (F.col("tag") == "a") & F.coalesce(attribute("href").startswith("/user/"), F.lit(False))
    every = markup.page_records(linked_markup(spark, d), "html", has_class("tlLinkItem"), {"href": (user, attribute("href")), "name": (user, None), "followers": ((F.col("tag") == "span") & has_class("spL"), None)}, key)
    every = every.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("open", F.struct("name", "href", F.col("followers").cast("int").alias("followers")).alias("item")))).alias("items"))
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["item"]["name"], x["item"]["href"], x["item"]["followers"].cast("string"))), ",")
    return every.select("row_id", F.size("items").alias("n"), shown.alias("linked"))


QUERIES = {f.__name__: f for f in (element_counts, html_links, html_row_tokenize, embedded_array_extract, nav_items, track_rows, notice_rows, linked_items)}

_SHOWN = r"regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<title>.*?</title>', '', 'g')"
_PLAIN = """replace(replace(replace(replace({}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""
_TIDY = r"trim(regexp_replace({}, '[\s\x{{A0}}]+', ' ', 'g'))"
ORACLES: dict[str, str] = {
    "element_counts": rf"WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)(<script>).*?</script>|(<style>).*?</style>|<!--.*?-->', '\1\2', 'g'), '<[a-z][^>]*>')) AS t FROM pages) SELECT page_id, regexp_extract(t, '[a-z][a-z0-9]*') AS tag, count(*) AS n, count(*) FILTER (contains(t, '=')) AS attributed FROM t GROUP BY ALL",
    "html_links": f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS t FROM pages), b AS (SELECT page_id, unnest(range(len(t))) AS place, unnest(t) AS tag FROM a) SELECT page_id, place::INT AS place, {_PLAIN.format("""regexp_extract(tag, 'href="([^"]*)"', 1)""")} AS href, {_PLAIN.format("regexp_extract(tag, '>([^<]*)<', 1)")} AS label FROM b""",
    "html_row_tokenize": rf"WITH a AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:] AS t FROM pages), b AS (SELECT page_id, unnest(range(len(t))) AS place, regexp_extract(unnest(t), '(?s)^(.*?)(</p>|$)', 1) AS inn FROM a) SELECT page_id, place::INT AS place, length({_TIDY.format(_PLAIN.format("regexp_replace(inn, '<[^>]*>', ' ', 'g')"))})::INT AS n, contains(inn, '<')::INT AS marked FROM b",
    "embedded_array_extract": r"SELECT page_id, 'track' AS called, 1 AS n, regexp_extract(html, 'track\(([0-9]+)\)', 1)::BIGINT AS first FROM pages",
    "nav_items": f"""WITH a AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>.*?</li>') AS t FROM pages), b AS (SELECT page_id, unnest(range(len(t))) AS place, unnest(t) AS tag FROM a) SELECT page_id, place::INT AS place, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, {_PLAIN.format("regexp_extract(tag, '>([^<>]*)</a>', 1)")} AS label, 2 AS below FROM b""",
    "track_rows": """SELECT o_orderkey AS row_id, o_orderkey AS tlp_id, o_orderstatus = 'F' AS is_ided, o_orderpriority[1] IN ('1', '2') AS is_concurrent, (o_orderkey % 7000)::INT AS cue_seconds, (o_orderkey % 7000)::INT AS cue_time_seconds,
  c_name || ' & "Co" - ' || lower(o_orderpriority) || ' (Live Mix)' AS full_name, (o_orderkey % 600 // 60 * 60 + o_orderkey % 60)::INT AS duration_seconds, lower(o_orderpriority) AS title, o_custkey AS track_id, o_orderstatus = 'P' AS is_remix, true AS spotify, o_orderstatus = 'O' AS apple
  FROM orders JOIN customer ON c_custkey = o_custkey""",
    "notice_rows": """SELECT event_id AS row_id, ['warning_title_wrong', 'recycle_notice', 'new_added_video', 'add_missing_live_video', 'info_notice', 'artist_played', 'headtext', 'identical_tracklist_link', 'unknown'][k % 9 + 1] AS kind,
  ['Title wrong', 'see identical tracklist(s): T ' || user_id, 'New added video track(s)', 'Add missing live video', 'Info', 'D' || user_id || ' & X < Y played:', 'Stage ' || user_id, 'Set : identical tracklist start', 'plain words'][k % 9 + 1] AS words,
  [0, 1, 0, 0, 0, 2, 0, 1, 0][k % 9 + 1] AS links, CASE k % 9 WHEN 1 THEN '/tracklist/' || user_id WHEN 5 THEN '/dj/' || user_id || '/' WHEN 7 THEN '/tracklist/' || user_id END AS first_link,
  CASE k % 9 WHEN 3 THEN user_id::VARCHAR WHEN 5 THEN 'tlp_' || event_id END AS named FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "linked_items": '''SELECT l_orderkey AS row_id, count(*)::INT AS n, string_agg('U' || l_suppkey || ':/user/' || l_suppkey || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_suppkey::VARCHAR || '"') AS linked FROM lineitem GROUP BY 1''',
}
