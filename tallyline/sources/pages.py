"""Structured rows out of raw pages, with built-in functions.

Pages are cut into tokens (tags, comments, scripts, text) once.  Nesting is a running
sum over a page's tokens, and what a token lies in is the last thing opened at its depth,
so tags may have any attributes, may lack their end tag and may be nested.  Pages are dealt
to tasks whole; their tokens stay in the task, as Arrow arrays of many pages, and only the
rows found leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.scalars import points

# fixed values: team name, four quarter scores "goals.behinds", final score
SCORE_LINE = r"^(.+?)\s*(\d+)\.(\d+)\s+(\d+)\.(\d+)\s+(\d+)\.(\d+)\s+(\d+)\.(\d+)\s+(\d+)"
ARROWS = "[\u2197\u2199]"


def clean_spaces(text: Column) -> Column:
    return F.trim(F.translate(text, "\u00a0\u2002", "  "))


def score_record(line: Column) -> Column:
    """Struct of team, points per quarter and final score; null when the line is none."""
    text = clean_spaces(line)

    def group(i: int) -> Column:
        return F.regexp_extract(text, SCORE_LINE, i)

    def quarter(i: int) -> Column:
        return points(group(2 * i).try_cast("int"), group(2 * i + 1).try_cast("int"))

    return F.when(text.rlike(SCORE_LINE), F.struct(
        F.trim(group(1)).alias("team"), *[quarter(i).alias(f"q{i}") for i in (1, 2, 3, 4)],
        group(10).try_cast("int").alias("final_score")))


def match_records(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with exactly two score lines -> one match row; other pages are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), score_record), lambda r: r.isNotNull())
    # fixed values: the page's labels and date form
    attendance = F.regexp_replace(F.regexp_extract(text, r"Att:\s*([\d,]+)", 1), ",", "").try_cast("int")
    venue = F.trim(F.regexp_extract(text, r"Venue:\s*([^\n]+)", 1))
    date = F.regexp_extract(text, r"(\w{3}\s+\d{2}-\w{3}-\d{4})", 1)
    rows = pages.select("page_id", attendance.alias("attendance"), F.nullif(venue, F.lit("")).alias("venue"),
                        F.nullif(date, F.lit("")).alias("date"), lines.alias("r")).where(F.size("r") == 2)
    return rows.select("page_id", "attendance", "venue", "date", *[
        F.col("r")[i][f].alias(f"{side}_{f}")
        for i, side in enumerate(("home", "away")) for f in ("team", "q1", "q2", "q3", "q4", "final_score")])


def headings(pages: DataFrame) -> DataFrame:
    """Title and first heading of each page, tags removed."""
    return pages.select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_replace(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), "<[^>]*>", "").alias("heading"))


def link_ids(pages: DataFrame, pattern: str) -> DataFrame:
    """Ids in the links of a page, each once, at the position first seen.

    ``pattern`` has one group, the id.
    """
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all(
        "html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))
    found = links.select("page_id", "pos", F.regexp_extract("href", pattern, 1).alias("link_id"))
    return found.where("link_id <> ''").groupBy("page_id", "link_id").agg(F.min("pos").alias("first_pos"))


# scripts, styles and comments whole; tags with quoted attributes; text
TOKEN = (r"(?is)<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<!--.*?(?:-->|$)|<[!?][^>]*>"
         r"|</?[a-z][^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*>|[^<]+|<")


def tokens(pages: DataFrame, tags: Sequence[str], text: str = "html") -> DataFrame:
    """``page_id, page, at, tag, closes, text``: the named tags and the text of each page in order.

    ``page`` tells rows with one page id apart.  Comments, scripts and styles are left out.
    """
    numbered = pages.select("page_id", F.monotonically_increasing_id().alias("page"), text)
    cut = numbered.select("page_id", "page", F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    named = cut.select("page_id", "page", "at", "token", tag.alias("tag"))
    is_text = (F.col("tag") == "") & ~F.col("token").rlike("^<[!?]")
    return named.where(F.col("tag").isin(*tags) | is_text).select(
        "page_id", "page", "at", "tag", F.col("token").startswith("</").alias("closes"), F.when(is_text, F.col("token")).alias("text"))


#: Tokens of one go of a task, more only for a single page.
AT_ONCE = 1 << 19


def _latest(groups: np.ndarray, event: np.ndarray, none: int) -> np.ndarray:
    """The latest ``event`` up to each token among the tokens of its group; ``none`` marks tokens without one."""
    order = np.argsort(groups, kind="stable")
    sorted_groups, along = groups[order], np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.append(True, sorted_groups[1:] != sorted_groups[:-1])[: len(order)], along, 0))
    last = np.maximum.accumulate(np.where(event[order] != none, along, -1))
    out = np.empty(len(order), np.int64)
    out[order] = np.where(last >= first, event[order][last], none)
    return out


class Placed:
    """Tokens of some pages in order, with the innermost open ``container`` they lie in, and the open ``row`` and ``cell`` of that container.

    Each is the place of its opening tag, negative for none.  A row or cell ends at its
    end tag, at the next one, or with its container; what lies in a nested container
    belongs to that one alone.
    """

    def __init__(self, pages: pa.Array, containers: Sequence[str], cells: Sequence[str], rows: Sequence[str] = ()):
        token = pages.flatten()
        self.page = pc.list_parent_indices(pages).to_numpy(zero_copy_only=False).astype(np.int64)
        tag = pc.ascii_lower(pc.struct_field(pc.extract_regex(token, r"^</?(?P<tag>[A-Za-z][A-Za-z0-9]*)"), "tag"))
        flag = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        of = lambda names: flag(pc.is_in(tag, pa.array(list(names), pa.string())))
        closes, at, none = flag(pc.starts_with(token, "</")), np.arange(len(token)), -2
        holds, cell, row = of(containers), of(cells), of(rows)
        is_text = flag(pc.is_null(tag)) & ~flag(pc.starts_with(token, "<!")) & ~flag(pc.starts_with(token, "<?"))
        self.text = pc.if_else(pa.array(is_text), token, "")
        if not len(token):
            self.container = self.row = self.cell = at
            return
        total = np.cumsum(np.where(holds, np.where(closes, -1, 1), 0))
        first = np.searchsorted(self.page, self.page)  # a page's depth begins at its own first token
        depth = total - np.where(first > 0, total[first - 1], 0)
        depth -= depth.min()
        self.container = _latest(self.page * (depth.max() + 1) + depth, np.where(holds & ~closes, at, none), none)
        within = np.where(self.container >= 0, self.container, -1 - self.page)
        self.row = _latest(within, np.where(row, np.where(closes, -1, at), none), none)
        self.cell = _latest(within, np.where(cell & ~closes, at, np.where(cell | row, -1, none)), none)

    def cells(self, kept: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The place of each cell of the kept tokens, in order, and its own text."""
        chosen = np.flatnonzero(kept)
        chosen = chosen[np.argsort(self.cell[chosen], kind="stable")]
        places, starts = np.unique(self.cell[chosen], return_index=True)
        pieces = pa.ListArray.from_arrays(pa.array(np.append(starts, len(chosen)), pa.int32()), self.text.take(pa.array(chosen)))
        return places, pc.utf8_trim(pc.binary_join(pieces, ""), " ")


def _within(groups: np.ndarray) -> np.ndarray:
    """The number of each entry among its group, from 0; groups are sorted."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _in_tasks(pages: DataFrame, text: str, found: Callable[[pa.Array], tuple[np.ndarray, list[pa.Array]]], columns: list[T.StructField]) -> DataFrame:
    """``page_id, page`` and the columns that ``found`` makes of the tokens of some pages: the page of each row, and its values.

    ``page`` tells rows with one page id apart.  One shuffle, of whole pages; a page's tokens are a task's smallest unit.
    """
    numbered = pages.select("page_id", F.monotonically_increasing_id().alias("page"), text).repartition("page")
    cut = numbered.select("page_id", "page", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"))
    schema = T.StructType([cut.schema["page_id"], T.StructField("page", T.LongType()), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                some = batch.slice(low, high - low)
                page, values = found(some.column("tokens"))
                at = pa.array(page)
                yield pa.RecordBatch.from_arrays([some.column("page_id").take(at), some.column("page").take(at), *values], schema.names)
                low = high

    return cut.mapInArrow(run, schema)


def item_rows(pages: DataFrame, tag: str = "li", text: str = "html") -> DataFrame:
    """Items of a page's lists as rows: tags and arrows removed, blank and total rows dropped.

    An item's text is its own, not that of lists inside it.  ``pos`` counts all items of a page.
    """
    def found(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        inside = Placed(tokens, ["ul", "ol"], [tag])
        places, texts = inside.cells(inside.cell >= 0)
        page = inside.page[places]
        return page, [pa.array(_within(page), pa.int32()), texts]

    items = _in_tasks(pages, text, found, [T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])
    own = F.trim(F.regexp_replace("item", ARROWS, ""))
    return (items.select("page_id", "pos", own.alias("item"))
            .where((F.col("item") != "") & ~F.upper("item").isin("TOTAL", "TOTALS")))


def page_tables(pages: DataFrame, text: str = "html") -> DataFrame:
    """``page_id, page, table, pos, cells``: the rows of a page's tables, also of nested ones, with their cells' texts in order.

    ``table`` and ``pos`` count from 0 over the whole page; rows without cells are no rows.
    """
    def found(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        inside = Placed(tokens, ["table"], ["td", "th"], ["tr"])
        places, texts = inside.cells((inside.row >= 0) & (inside.cell >= 0))
        order = np.lexsort((places, inside.row[places]))
        rows, starts = np.unique(inside.row[places][order], return_index=True)
        cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), texts.take(pa.array(order)))
        page = inside.page[rows]
        # tables by the place of their tag; on a page, rows outside of any table come first
        tables, table = np.unique(np.column_stack([page, inside.container[rows]]), axis=0, return_inverse=True)
        return page, [pa.array(_within(tables[:, 0])[table.reshape(-1)], pa.int32()), pa.array(_within(page), pa.int32()), cells]

    return _in_tasks(pages, text, found, [T.StructField("table", T.IntegerType()), T.StructField("pos", T.IntegerType()),
                                          T.StructField("cells", T.ArrayType(T.StringType()))]).select("page_id", "page", "table", "pos", "cells")


def _usable(cells: str, n: Column | int) -> Column:
    first = F.get(cells, F.lit(0))
    return (F.size(cells) == n) & (first != "") & ~F.upper(first).isin("TOTAL", "TOTALS")


def _named(first: Column) -> Column:
    return F.trim(F.regexp_replace(first, ARROWS, ""))


def table_rows(pages: DataFrame, columns: list[str], text: str = "html") -> DataFrame:
    """Table rows with the right number of cells; blank, total and heading rows dropped, names cleaned."""
    rows = page_tables(pages, text).where(_usable("cells", len(columns)) & (F.get("cells", F.lit(0)) != columns[0]))
    return rows.select("page_id", "pos", _named(F.col("cells")[0]).alias(columns[0]),
                       *[F.col("cells")[i].alias(n) for i, n in enumerate(columns) if i])


def titled_rows(pages: DataFrame, first_title: str, text: str = "html") -> DataFrame:
    """``page_id, table, pos, values``: rows of the tables whose first row begins with ``first_title``, by that row's titles.

    Rows with another number of cells than titles are dropped, and blank and total rows.
    Of equal titles the last one counts.
    """
    rows = page_tables(pages, text)
    first = F.first("cells").over(Window.partitionBy("page", "table").orderBy("pos"))
    titled = rows.withColumn("titles", first).withColumn("n", F.min("pos").over(Window.partitionBy("page", "table")))
    kept = titled.where((F.get("titles", F.lit(0)) == first_title) & (F.col("pos") > F.col("n")) & _usable("cells", F.size("titles")))
    values = F.concat(F.array(_named(F.col("cells")[0])), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))))
    pairs = F.arrays_zip(F.col("titles").alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(F.col("titles"), i + 2, F.size("titles")), p["k"]))
    return kept.select("page_id", "table", "pos", F.map_from_entries(last).alias("values"))


def table_records(pages: DataFrame, text: str = "html") -> DataFrame:
    """Match records of pages where every match is a table of its own: a score line per row, attendance, venue and date anywhere.

    Adds ``table``; tables without exactly two score lines are dropped.
    """
    lines = page_tables(pages, text).groupBy("page", "page_id", "table").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.array_join("cells", " ").alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    return match_records(lines.select(F.struct("page_id", "table").alias("page_id"), "text")).select(
        "page_id.page_id", "page_id.table", *[c for c in RECORD_COLUMNS])


RECORD_COLUMNS = ["attendance", "venue", "date", *[
    f"{side}_{f}" for side in ("home", "away") for f in ("team", "q1", "q2", "q3", "q4", "final_score")]]
