"""Structure of paged documents: repeated lines, headings, chunks, table runs, alignment with the source text."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquill.functions.columns import heading_level


def line_template(line: Column) -> Column:
    """A line with its numbers as one mark and without outer blanks, to recognise running headers."""
    return F.trim(F.regexp_replace(line, "[0-9]+", "#"))


def edge_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, edge, line): first and last non-blank line of each page."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rows = pages.select(doc, page, lines.alias("l")).where("size(l) > 0")
    both = F.array(F.struct(F.lit("first").alias("edge"), F.element_at("l", 1).alias("line")), F.struct(F.lit("last").alias("edge"), F.element_at("l", -1).alias("line")))
    return rows.select(doc, page, F.explode(both).alias("x")).select(doc, page, "x.edge", F.trim("x.line").alias("line"))


def furniture(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.2, least: int = 2) -> DataFrame:
    """(doc, edge, template, on_pages): edge lines that recur on at least ``share`` of a document's pages and ``least`` pages."""
    count = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    seen = edge_lines(pages, doc, page, text).select(doc, page, "edge", line_template(F.col("line")).alias("template")).distinct().groupBy(doc, "edge", "template").agg(F.count("*").alias("on_pages"))
    return seen.join(count, doc).where((F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))) & (F.length("template") > 0)).select(doc, "edge", "template", "on_pages")


def without_furniture(pages: DataFrame, doc: str, page: str, text: str, found: DataFrame, most: float = 0.5) -> DataFrame:
    """Pages with their furniture lines removed, unless more than ``most`` of the characters would go."""
    rows = edge_lines(pages, doc, page, text).withColumn("template", line_template(F.col("line"))).join(found.select(doc, "edge", "template"), [doc, "edge", "template"])
    cut = rows.groupBy(doc, page).agg(F.collect_set("line").alias("__drop"))
    joined = pages.join(cut, [doc, page], "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.coalesce("__drop", F.array().cast("array<string>")), F.trim(x))), "\n")
    return joined.withColumn("__left", left).withColumn("kept_text", F.when(F.length("__left") >= F.length(text) * (1 - most), F.col("__left")).otherwise(F.col(text))).drop("__drop", "__left")


def is_contents_page(text: Column) -> Column:
    """Half or more of at least three lines end in leaders and a page number."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    led = F.filter(lines, lambda x: x.rlike("(\\.{3,}|…{2,}|·{3,})\\s*[0-9]+\\s*$"))
    return (F.size(lines) >= 3) & (F.size(led) * 2 >= F.size(lines))


def page_number_offset(labels: DataFrame, doc: str, page: str, label: str) -> DataFrame:
    """The commonest difference of printed and physical page number per document, ties to the smaller, with its support."""
    off = labels.where(F.col(label).isNotNull()).groupBy(doc, (F.col(label) - F.col(page)).alias("offset")).agg(F.count("*").alias("support"))
    return off.groupBy(doc).agg(F.max(F.struct("support", (-F.col("offset")).alias("neg"))).alias("x")).select(doc, (-F.col("x.neg")).alias("offset"), F.col("x.support").alias("support"))


def carried_sections(blocks: DataFrame, doc: Sequence[str], order: Sequence[str], text: Column) -> DataFrame:
    """Each block with the last heading at or before it and that heading's level."""
    level = heading_level(text)
    so_far = W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    head = F.when(level.isNotNull(), F.struct(level.alias("level"), F.substring(F.trim(text), 1, 50).alias("title")))
    rows = blocks.withColumn("__head", F.last(head, ignorenulls=True).over(so_far))
    return rows.withColumn("section", F.col("__head.title")).withColumn("section_level", F.col("__head.level")).drop("__head")


def chunks(text: Column, limit: int = 1200, overlap: int = 100) -> Column:
    """array<string>: paragraphs (between blank lines) packed up to ``limit``; a longer one sliced with ``overlap``."""
    paragraphs = F.filter(F.transform(F.split(text, "\\n[^\\S\\n]*\\n"), F.trim), lambda p: p != "")
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(p) - overlap - 1, F.lit(0)) / (limit - overlap)).cast("int")), lambda i: F.substring(p, i * (limit - overlap) + 1, F.lit(limit)))
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > limit, slices(p)).otherwise(F.array(p))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, p: Column) -> Column:
        fits = F.length(state["open"]) + F.length(p) + 2 <= limit
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        flushed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.when(fits, F.struct(state["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(flushed.alias("done"), p.alias("open")))

    return F.aggregate(parts, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def table_runs(tables: DataFrame, doc: Sequence[str], page: str, signature: Column) -> DataFrame:
    """Tables of a document chained into runs: on the same or the next page, with the same header signature."""
    order = W.partitionBy(*doc).orderBy(page, "block_index", "evidence_id")
    rows = tables.withColumn("__sig", signature)
    follows = (F.col(page) - F.lag(page).over(order) <= 1) & F.col("__sig").eqNullSafe(F.lag("__sig").over(order)) & F.col("__sig").isNotNull()
    return rows.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__sig")


def split_glued(cell: Column) -> Column:
    """array(amount, percent) of two figures run together, such as 42,370,183.3100.0; null unless there is just one reading.

    The amount has two decimals, the percentage one or two and is at most 100.
    """
    amount = F.regexp_extract(cell, "^(-?[0-9][0-9,]*\\.[0-9]{2})([0-9]{1,3}\\.[0-9]{1,2})%?$", 1)
    percent = F.regexp_extract(cell, "^(-?[0-9][0-9,]*\\.[0-9]{2})([0-9]{1,3}\\.[0-9]{1,2})%?$", 2)
    return F.when((amount != "") & (percent.try_cast("double") <= 100), F.array(amount, percent))


@F.pandas_udf(T.DoubleType())
def match_coverage(block: pd.Series, page: pd.Series) -> pd.Series:
    """Share of a block's characters that a sequence match finds in its page; 0 for an empty block, null for a null."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        return sum(m.size for m in blocks) / len(a) if a else 0.0

    return pd.Series([one(a, b) for a, b in zip(block, page, strict=True)], dtype=float)


@F.pandas_udf(T.IntegerType())
def common_substring_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common substring."""

    def one(a: str | None, b: str | None) -> int | None:
        if a is None or b is None:
            return None
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        row, best = np.zeros(len(y) + 1, np.int32), 0
        for c in x:
            row[1:] = np.where(y == c, row[:-1] + 1, 0)
            best = max(best, int(row.max()))
        return best

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


def snippet(text: Column, shortest: int = 20, longest: int = 120) -> Column:
    """An opening snippet that ends with a sentence within the window, else the whole text if it fits, else null."""
    head = F.regexp_extract(text, f"^([\\s\\S]{{{shortest - 1},{longest - 1}}}[。！？.!?])", 1)
    return F.when(head != "", head).when(F.length(text).between(shortest, longest), text)


def topic_end(blocks: DataFrame, doc: Sequence[str], anchor: str, place: str, outside: Column) -> DataFrame:
    """Per anchor the first place after it whose block lies outside the topic; null if none does."""
    return blocks.groupBy(*doc, anchor).agg(F.min(F.when((F.col("offset") > 0) & outside, F.col(place))).alias("topic_end"))


# Words that refer to a table nearby, and those that refer to a named place, with the marks that end its name.
TABLE_MARKERS = ("如下表所示", "见下表", "如下表", "下表", "上表", "见上表", "如上表")
NAMED_MARKERS = ("详见", "参见", "请参阅", "参阅", "见本")
NAME_ENDS = "。；;，,、！？\n"


def reference_occurrences(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, occurrence, kind, marker, start, end, target) of all references in a text, in order and without overlap.

    At one place the longest marker counts. A table marker does not begin inside a named one; a named reference whose target
    is itself a table marker counts as the table's, and one without a target as none. Null texts give no rows.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *(T.StructField(n, T.IntegerType() if n in ("occurrence", "start", "end") else T.StringType()) for n in ("occurrence", "kind", "marker", "start", "end", "target"))])
    longest = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    named, tables = re.compile(f"({longest(NAMED_MARKERS)})([^{NAME_ENDS}]*)"), re.compile(longest(TABLE_MARKERS))

    def of(text: str) -> list[tuple]:
        found, inside = [], set()
        for hit in named.finditer(text):
            inside.update(range(hit.start() + 1, hit.end(1)))
            target = hit.group(2).strip(" \t\r“”‘’\"'（）()：:")
            if target and not tables.fullmatch(target):
                found.append((hit.start(), hit.end(1), "named", hit.group(1), target))
        at = 0
        while hit := tables.search(text, at):
            at = hit.start() + 1 if hit.start() in inside else hit.end()
            if hit.start() not in inside:
                found.append((hit.start(), hit.end(), "table", hit.group(), None))
        out, upto = [], 0
        for start, end, kind, marker, target in sorted(found, key=lambda x: (x[0], -x[1])):
            if start >= upto:
                out.append((len(out), kind, marker, start, end, target))
                upto = end
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) for x in of(t)]
            columns = list(zip(*hits, strict=True)) if hits else [()] * 7
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=schema.names)

    return rows.where(F.col(text_col).isNotNull()).select(key, text_col).mapInArrow(read, schema)


def toc_entries(rows: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """(keys, line, title, page) of the lines of a contents page: a title, leaders or wide blanks, and a page number at the end."""
    pattern = "^\\s*(\\S.*?)\\s*(?:[.·…]{2,}|\\s{3,})\\s*([0-9]{1,4})\\s*$"
    lines = rows.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line", "__l")).where(F.col("__l").rlike(pattern))
    return lines.select(*keys, "line", F.regexp_extract("__l", pattern, 1).alias("title"), F.regexp_extract("__l", pattern, 2).cast("int").alias("page"))


def outline(headings: DataFrame, doc: Sequence[str], order: Sequence[str], node: str, level: str, levels: int = 4) -> DataFrame:
    """(doc, node, level, parent) of the headings of a document: the parent is the last heading before it of an outer level.

    Headings without a level or of one beyond ``levels`` are left out. One pass over the headings of each document.
    """
    so_far = W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = headings.where(F.col(level).between(1, levels))
    last = {n: F.max(F.when(F.col(level) == n, F.struct(*order, F.col(node).alias("__node")))).over(so_far) for n in range(1, levels)}
    outer = [F.when(F.col(level) > n, last[n]) for n in last]
    return rows.withColumn("__p", F.greatest(*outer) if len(outer) > 1 else outer[0]).select(*doc, node, level, F.col("__p.__node").alias("parent"))


def note_cells(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, label, cell, value) of rows of a note table given as text: a label, then amounts with decimals in their columns."""
    found = rows.select(key, F.regexp_extract(text_col, "^\\s*(\\S+)", 1).alias("label"), F.posexplode(F.regexp_extract_all(text_col, F.lit("(?<![0-9.,])(-?[0-9][0-9,]*\\.[0-9]+)(?![0-9,]|\\.[0-9])"), F.lit(1))).alias("cell", "__v"))
    return found.select(key, "label", "cell", F.regexp_replace("__v", ",", "").try_cast("decimal(24,4)").alias("value"))


def with_table_context(blocks: DataFrame, doc: Sequence[str], order: Sequence[str], within: int = 1) -> DataFrame:
    """Rows of tables with ``table_id`` and ``table_title`` of the last table block before them, if it is at most ``within`` pages back."""
    so_far = W.partitionBy(*doc).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    head = F.last(F.when(F.col("evidence_type") == "table", F.struct("evidence_id", "text", "page_number")), ignorenulls=True).over(so_far)
    rows = blocks.where("evidence_type in ('table', 'table_row')").withColumn("__t", head).where("evidence_type = 'table_row'")
    near = F.col("page_number") - F.col("__t.page_number") <= within
    return rows.withColumn("table_id", F.when(near, F.col("__t.evidence_id"))).withColumn("table_title", F.when(near, F.col("__t.text"))).drop("__t")
