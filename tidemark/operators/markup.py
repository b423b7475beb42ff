"""Markup as a table of elements, so that what is inside what, rows, links and fields are joins and columns.

Each element has an open and a close number: one is inside another if its numbers lie between the
other's. Texts are rows of their own, tag `#text` (`#script` inside script and style), with one number for both.
Malformed pages give some tree, as browsers do: void elements end at once; a closing
tag ends the nearest open element of that name and all that was opened in it, one that ends nothing is
left out; elements whose end may be left out end where the next begins; the rest ends with the page;
attributes may be quoted, unquoted or without value, the first of a name counts; a `<` that
begins no tag is text. Names are lower-cased, character references resolved, comments left out.
"""

from __future__ import annotations

import html as standard
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .streams import dealt

# Fixed values of the HTML standard: elements without content, with raw content, and which open ones a start tag ends (and no farther up than which).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})} | {b: ({"p"}, {"table", "button"}) for b in BLOCKS}

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_CLASS = re.compile(r"[^ \t\n\x0b\f\r]+")
_ROWS = 50_000
_KNOWN = 4_096
"""Start tags that a task remembers, as they are written: most are there again and again."""


def attributes_of(tag: str, rest: str) -> list[tuple[str, str]]:
    """The attributes in what follows the name of a start tag, the first of each name."""
    found: dict[str, str] = {}
    for key, double, single, bare in _ATTRIBUTE.findall(rest):
        value = double or single or bare
        found.setdefault(key.lower(), standard.unescape(value) if "&" in value else value)
    return list(found.items())


def parsed(page: str, kept: Callable[[str, str], Sequence] = attributes_of) -> list[tuple[int, int, int, int, str, Sequence, str | None]]:
    """open, close, depth, parent, tag, attributes (or what else is kept of a start tag), text of each element and text of a page, in the order of their ends."""
    done, stack, open_now, n, at = [], [], {}, 0, 0

    def end(above: int) -> None:
        nonlocal n
        while len(stack) > above:
            first, tag, attributes = stack.pop()
            open_now[tag] -= 1
            n += 1
            done.append((first, n, len(stack), stack[-1][0] if stack else 0, tag, attributes, None))

    def say(words: str, tag: str) -> None:
        nonlocal n
        if not words.isspace() and words:
            n += 1
            done.append((n, n, len(stack), stack[-1][0] if stack else 0, tag, [], words))

    while at < len(page):
        for found in _PIECE.finditer(page, at):
            slash, name, rest = found.groups()
            if name is None:
                words = found.group()
                if words[0] != "<" or len(words) == 1:
                    say(standard.unescape(words) if "&" in words else words, "#text")
                continue
            tag = name.lower()
            if slash:
                if open_now.get(tag):
                    i = len(stack) - 1
                    while stack[i][1] != tag:
                        i -= 1
                    end(i)
                continue
            if tag in ENDS and any(map(open_now.get, ENDS[tag][0])):
                ends, bounds = ENDS[tag]
                farthest = len(stack)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][1] in ends:
                        farthest = i
                    if stack[i][1] in bounds:
                        break
                end(farthest)
            n += 1
            stack.append((n, tag, kept(tag, rest)))
            open_now[tag] = open_now.get(tag, 0) + 1
            if tag in VOID:
                end(len(stack) - 1)
            elif tag in RAW:
                at = found.end()
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                stop = close.start() if close else len(page)
                say(page[at:stop] if tag in ("script", "style") else standard.unescape(page[at:stop]), "#script" if tag in ("script", "style") else "#text")
                at = stop
                break
        else:
            break
    end(0)
    return done


def elements(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """keys, open, close, depth, parent (0: none), tag, attributes, text: one row an element or text; a null page has none."""
    names = ["open", "close", "depth", "parent", "tag", "attributes", "text"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            rows: list[tuple] = []
            for i, page in enumerate(batch.column(len(keys))):
                found = parsed(page.as_py()) if page.is_valid else []
                rows += found
                of += [i] * len(found)
                if rows and (len(rows) > _ROWS or i == batch.num_rows - 1):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in range(len(keys))), *columns], [*keys, *names])
                    of, rows = [], []
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in range(len(keys))), *columns], [*keys, *names])

    own = dict(pages.dtypes)
    schema = ", ".join(f"{k} {own[k]}" for k in keys) + ", open int, close int, depth int, parent int, tag string, attributes map<string,string>, text string"
    return pages.select(*keys, html).mapInArrow(run, schema)


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute("class"), r"\s+"), name), F.lit(False))


def tidy(text: Column) -> Column:
    """White space, no-break spaces among it, as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def inside(inner: DataFrame, outer: DataFrame, keys: list[str], outermost: bool = False) -> DataFrame:
    """inner with `within`: the open number of the innermost (or outermost) element of outer around it, null if there is none; not itself.

    Opens and closes of outer and rows of inner in one order: the running sum of opens less closes is how many are
    around a row, and the innermost is the last opened at that level. Two windows over a page, whatever is nested how.
    """
    row = F.struct(*inner.columns)
    none = F.lit(None).cast(inner.select(row.alias("r")).dtypes[0][1])
    ends = outer.select(*keys, F.explode(F.array(F.struct(F.col("open").alias("at"), F.lit(1).alias("step"), F.col("open").alias("first")), F.struct(F.col("close").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("first")))).alias("e"))
    both = ends.select(*keys, "e.at", "e.step", "e.first", none.alias("row")).unionByName(inner.select(*keys, F.col("open").alias("at"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("first"), row.alias("row")))
    upto = Window.partitionBy(*keys).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("level", F.sum("step").over(upto))
    if outermost:
        last = F.last(F.when(F.col("level") == 1, F.col("first")), ignorenulls=True).over(upto)
    else:
        last = F.last("first", ignorenulls=True).over(Window.partitionBy(*keys, "level").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("within", F.when(F.col("level") > 0, last)).filter("row IS NOT NULL")
    return both.select("row.*", "within")


def texts(pieces: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """outer with `words`: the texts inside it, tidied and joined by spaces; where elements of outer are nested, those of the outermost."""
    own = inside(pieces.filter("tag = '#text'"), outer, keys, outermost=True).filter("within IS NOT NULL")
    own = own.groupBy(*keys, F.col("within").alias("open")).agg(F.array_sort(F.collect_list(F.struct("open", "text"))).alias("all"))
    words = tidy(F.array_join(F.transform("all", lambda x: x["text"]), " "))
    return outer.join(own.select(*keys, "open", words.alias("words")), [*keys, "open"], "left").withColumn("words", F.coalesce("words", F.lit("")))


def records(found: DataFrame, row: Column, fields: dict[str, tuple[Column, Column | None]], keys: list[str]) -> DataFrame:
    """keys, open, attributes and a column a field, one row an element that `row` holds for.

    A field is a condition on elements inside the row and the value of the first that fits (of nested rows, those of
    the innermost count); without a value, its text.
    """
    rows = found.filter(row)
    marks = F.array_compact(F.array(*(F.when(fits, F.struct(F.lit(name).alias("field"), (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"))) for name, (fits, value) in fields.items())))
    # What is neither a text nor marked goes before anything is moved, and so do attributes.
    slim = found.withColumn("marks", marks).filter("size(marks) > 0 OR tag = '#text'").select(*keys, "open", "close", "tag", "text", "marks")
    own = inside(slim, rows, keys).filter("within IS NOT NULL").withColumnRenamed("within", "of_row")
    marked = own.select(*keys, "of_row", "open", "close", F.explode("marks").alias("m")).select(*keys, "of_row", "open", "close", "m.field", "m.value")
    spoken = [name for name, (_, value) in fields.items() if value is None]
    if spoken:
        said = own.filter("tag = '#text'").withColumn("field", F.explode(F.array(*map(F.lit, spoken))))
        told = texts(said, marked.filter(F.col("field").isin(spoken)), [*keys, "field"]).withColumn("value", F.nullif("words", F.lit(""))).drop("words")
        marked = marked.filter(~F.col("field").isin(spoken)).unionByName(told)
    firsts = [F.min_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("open"))).alias(name) for name in fields]
    filled = marked.groupBy(*keys, F.col("of_row").alias("open")).agg(*firsts)
    return rows.select(*keys, "open", "attributes").join(filled, [*keys, "open"], "left")


def page_records(pages: DataFrame, html: str, row: Column, fields: dict[str, tuple[Column, Column | None]], keys: list[str]) -> DataFrame:
    """What records() finds in elements(), where nothing else is asked of them: elements are joined in the task that parses their page, and only records leave it.

    Elements of a page come in the order of their ends, so a row takes what opened after it and no row inside it took.
    """
    names, spoken = list(fields), {name for name, (_, value) in fields.items() if value is None}
    kinds, k, page = dict(pages.dtypes), len(keys), 1 << 33
    blank = re.compile("[ \t\n\x0b\f\r\xa0]+")

    def whole(table: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        """Records of whole pages; number: which page each element is of."""
        opened, closed = (number * page + table.column(c).to_numpy() for c in ("open", "close"))
        is_row = table.column("__row").to_numpy()
        marks = [np.flatnonzero(table.column(f"__{i}").is_valid().to_numpy()) for i in range(len(names))]
        marked = np.zeros(len(number), dtype=bool)
        for at in marks:
            marked[at] = True
        of, waiting = np.full(len(number), -1), []
        for i in np.flatnonzero(is_row | marked).tolist():
            if is_row[i]:
                while waiting and opened[waiting[-1]] > opened[i]:
                    of[waiting.pop()] = i
            if marked[i]:
                waiting.append(i)
        said = np.flatnonzero(table.column("text").is_valid().to_numpy())
        said = said[np.argsort(opened[said], kind="stable")]
        starts, words = opened[said], table.column("text").take(pa.array(said)).to_pylist()
        rows = np.flatnonzero(is_row)
        columns = [table.column(c).take(pa.array(rows)) for c in (*keys, "open", "attributes")]
        for name, i, at in zip(names, range(len(names)), marks, strict=True):
            at = at[of[at] >= 0]
            at = at[np.argsort(opened[at], kind="stable")]
            first: dict[int, str | None] = {}
            if name in spoken:
                los, his, end = np.searchsorted(starts, opened[at], side="right").tolist(), np.searchsorted(starts, closed[at]).tolist(), -1
                for m, lo, hi in zip(at.tolist(), los, his, strict=True):
                    inner, end = opened[m] < end, max(end, closed[m])  # of nested ones the outermost has the words
                    first.setdefault(int(of[m]), None if inner else blank.sub(" ", " ".join(words[lo:hi])).strip(" ") or None)
            else:
                for m, value in zip(of[at].tolist(), table.column(f"__{i}").take(pa.array(at)).to_pylist(), strict=True):
                    first.setdefault(m, value[1:] if value else None)
            columns.append(pa.array([first.get(m) for m in rows.tolist()], pa.string()))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, [*keys, "open", "attributes", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            number = numbered(table)
            cut = int(np.searchsorted(number, number[-1])) if len(number) else 0  # the last page may go on in the next batch
            if cut:
                yield whole(table.slice(0, cut), number[:cut])
                held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield whole(table, numbered(table))

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        ends = table.column("close").to_numpy()
        new[1:] = ends[1:] <= ends[:-1]
        for c in table.columns[:k]:
            codes = c.combine_chunks().dictionary_encode()
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    found = elements(dealt(pages.select(*keys, html), *keys), html, keys)
    told = [F.when(fits, F.lit("") if value is None else F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))).alias(f"__{i}") for i, (fits, value) in enumerate(fields.values())]
    slim = found.select(*keys, "open", "close", F.coalesce(row, F.lit(False)).alias("__row"), F.when(F.coalesce(row, F.lit(False)), F.col("attributes")).alias("attributes"), F.when(F.col("tag") == "#text", F.col("text")).alias("text"), *told)
    slim = slim.filter(F.col("__row") | F.col("text").isNotNull() | F.coalesce(*(F.col(f"__{i}") for i in range(len(names)))).isNotNull())
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", open int, attributes map<string,string>, " + ", ".join(f"{n} string" for n in names)
    return slim.mapInArrow(run, schema)


class Field(NamedTuple):
    """An element by its tag, a class and a pattern in an attribute, as far as given, and what is read from it: an attribute, or its text."""

    tag: str | None = None
    of_class: str | None = None
    like: tuple[str, str] | None = None
    value: str | None = None


def parsed_records(pages: DataFrame, html: str, row: Field, fields: dict[str, Field], keys: list[str]) -> DataFrame:
    """What page_records() finds, where rows and fields are known by tag, class and attributes: each page is parsed and read in one go, and no element leaves the task.

    Pages are parsed where they lie, so the caller deals them, best before they are made.
    """
    kinds, names = dict(pages.dtypes), list(fields)
    rules = [(i, f.tag, f.of_class, f.like and f.like[0], f.like and re.compile(f.like[1]), f.value) for i, f in [(-1, row), *enumerate(fields.values())]]
    by_class = {c: [r for r in rules if r[2] == c] for c in {r[2] for r in rules} - {None}}
    by_none = [r for r in rules if r[2] is None and r[1] is None]
    by_tag = {t: [*by_none, *(r for r in rules if r[2] is None and r[1] == t)] for t in {r[1] for r in rules} - {None}}
    spoken, blank = [f.value is None for f in fields.values()], re.compile("[ \t\n\x0b\f\r\xa0]+")

    def fitting(tag: str, own: dict[str, str]) -> list[tuple[int, str | None]]:
        """Which fields an element fits (-1: it is a row), with their values."""
        out = [(i, own.get(value)) for i, _, _, name, pattern, value in by_tag.get(tag, by_none) if name is None or (name in own and pattern.search(own[name]))]
        for c in set(_CLASS.findall(own["class"])) if "class" in own else ():
            if c in by_class:
                out += [(i, own.get(value)) for i, t, _, name, pattern, value in by_class[c] if (t is None or t == tag) and (name is None or (name in own and pattern.search(own[name])))]
        return out

    def read(page: str, kept: Callable[[str, str], Sequence]) -> list[tuple[int, list[tuple[str, str]], list[str | None]]]:
        """open, attributes and values of each row; a row takes what opened after it and no row inside it took."""
        rows, waiting, starts, words = [], [], [], []
        said: list[list[tuple[int, int, int]]] = [[] for _ in names]
        for first, last, _, _, tag, own, text in parsed(page, kept):
            if text is not None:
                if tag == "#text":
                    starts.append(first)
                    words.append(text)
                continue
            if not own:
                continue
            attributes, fits, is_row = own
            if is_row:
                values: list[str | None] = [None] * len(names)
                opened = [0] * len(names)
                while waiting and waiting[-1][0] > first:
                    at, end, i, value = waiting.pop()
                    if spoken[i]:
                        said[i].append((at, end, len(rows)))
                    elif not opened[i] or at < opened[i]:
                        opened[i], values[i] = at, value
                rows.append((first, attributes, values))
            for i, value in fits:
                if i >= 0:
                    waiting.append((first, last, i, value))
        for i, marks in enumerate(said):
            told, reach = set(), 0
            for at, end, of in sorted(marks):
                if of not in told and at > reach:  # of nested ones the outermost has the words
                    rows[of][2][i] = blank.sub(" ", " ".join(words[bisect_right(starts, at) : bisect_left(starts, end)])).strip(" ") or None
                told.add(of)
                reach = max(reach, end)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], Sequence] = {}

        def kept(tag: str, rest: str) -> Sequence:
            """Attributes, fields and whether it is a row of an element that fits; nothing of another."""
            own = known.get((tag, rest))
            if own is None:
                fits = fitting(tag, dict(attributes := attributes_of(tag, rest)))
                own = (attributes, fits, any(i < 0 for i, _ in fits)) if fits else ()
                if len(known) < _KNOWN:
                    known[tag, rest] = own
            return own

        for batch in batches:
            found = [(i, *own) for i, page in enumerate(batch.column(len(keys)).to_pylist()) if page is not None for own in read(page, kept)]
            of, opened, attributes, values = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [*(batch.column(k).take(pa.array(of, pa.int64())) for k in range(len(keys))), pa.array(opened, pa.int32()), pa.array(attributes, pa.map_(pa.string(), pa.string()))]
            columns += [pa.array([own[i] for own in values], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "open", "attributes", *names])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", open int, attributes map<string,string>, " + ", ".join(f"{n} string" for n in names)
    return pages.select(*keys, html).mapInArrow(run, schema)


def items(found: DataFrame, row: Column, item: Column, keys: list[str]) -> DataFrame:
    """keys, of_row, place (from 0), open, attributes, words: the elements in each row that `item` holds for, in order."""
    inner = inside(found.filter(item), found.filter(row), keys).filter("within IS NOT NULL").withColumnRenamed("within", "of_row")
    place = F.row_number().over(Window.partitionBy(*keys, "of_row").orderBy("open")) - 1
    return texts(found, inner, keys).select(*keys, "of_row", place.alias("place"), "open", "attributes", "words")


def arguments(call: Column) -> Column:
    """The name: 'value' pairs of an object in a script call, as a map; the last of a name counts."""
    pairs = F.regexp_extract_all(call, F.lit(r"(\w+\s*:\s*'[^']*')"), F.lit(1))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^\w+", 0).alias("key"), F.regexp_extract(p, "'([^']*)'", 1).alias("value"))
    return F.aggregate(F.transform(pairs, entry), F.create_map().cast("map<string,string>"), lambda done, e: F.map_concat(F.map_filter(done, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def notice_kind(words: Column, icons: Column, headline: Column, played: Column, interactive: Column, linked: Column) -> Column:
    """What a notice row says, by its icons first, then its marks and words; the first rule that fits."""
    low = F.lower(words)
    icon = lambda name: F.array_contains(icons, name)
    return (
        F.when(icon("fa-exclamation-triangle"), "warning_title_wrong")
        .when(icon("fa-recycle") | low.contains("identical tracklist(s)"), "recycle_notice")
        .when(low == "new added video track(s)", "new_added_video")
        .when(interactive & low.contains("add missing live video"), "add_missing_live_video")
        .when(icon("fa-info-circle"), "info_notice")
        .when(played & low.contains("played:") & icon("fa-trash"), "artist_played")
        .when(headline, "headtext")
        .when(linked & low.rlike(r"\bidentical\s+tracklist\s+(start|end)\b"), "identical_tracklist_link")
        .otherwise("unknown")
    )
