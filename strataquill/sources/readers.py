"""Sources: Parquet, CSV and JSON lines under a schema, page texts, HTML, XLSX cells, SQLite tables."""

from __future__ import annotations

import html.parser
import io
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): lines that do not parse under the schema are kept apart, not dropped."""
    lines = spark.read.text(path).where("trim(value) != ''")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.where("not bad").select("r.*"), parsed.where("bad").select(F.col("value").alias("line"))


def csv_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, page_number, text) of text files whose pages are parted by form feeds."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("source"), "value")
    return files.select("source", F.posexplode(F.split("value", "\f")).alias("p", "text")).select("source", (F.col("p") + 1).alias("page_number"), "text")


class _Text(html.parser.HTMLParser):
    SKIP = frozenset(("script", "style", "noscript", "template", "head"))
    BREAK = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.SKIP))
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text of HTML: one line per block element, blanks folded; null stays null."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        parser.close()
        lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(parser.parts).split("\n"))
        return "\n".join(line for line in lines if line)

    return pages.map(one, na_action=None)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_CELLS = "source string, sheet string, row int, col int, address string, value string, formula string, merged_from string"


def _column(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, row, col, address, value, formula, merged_from) of all cells; a merged range repeats its first value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS)]
        out = []
        for n, sheet in enumerate(sheets, 1):
            if f"xl/worksheets/sheet{n}.xml" not in names:
                continue
            root = ET.fromstring(book.read(f"xl/worksheets/sheet{n}.xml"))
            values = {}
            for cell in root.iter(f"{{{_NS['m']}}}c"):
                v, f = cell.find("m:v", _NS), cell.find("m:f", _NS)
                text = v.text if v is not None else "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) or None
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                letters, row = re.match(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                values[int(row), _column(letters)] = (cell.get("r"), text, f.text if f is not None else None)
            merged = {}
            for area in root.iter(f"{{{_NS['m']}}}mergeCell"):
                a, _, b = area.get("ref").partition(":")
                (c1, r1), (c2, r2) = (re.match(r"([A-Z]+)(\d+)", x).groups() for x in (a, b or a))
                for r in range(int(r1), int(r2) + 1):
                    for c in range(_column(c1), _column(c2) + 1):
                        merged[r, c] = (int(r1), _column(c1), a)
            for at in sorted(set(values) | set(merged)):
                address, text, formula = values.get(at, (None, None, None))
                origin = merged.get(at)
                if origin and at != origin[:2]:
                    text = values.get(origin[:2], (None, None, None))[1]
                out.append((sheet, *at, address, text, formula, origin[2] if origin and at != origin[:2] else None))
        return out


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbooks with their coordinates, read in parallel by file; a file that is no workbook gives no rows."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("source"), "content")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, content in frame.itertuples(index=False):
                try:
                    rows += [(source, *cell) for cell in workbook_cells(content)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["source", "sheet", "row", "col", "address", "value", "formula", "merged_from"])

    return files.mapInPandas(scan, _CELLS)


def statement_candidates(cells: DataFrame) -> DataFrame:
    """Cells of a statement as rows: label (first text cell of the row), period header (nearest dated cell above), raw value."""
    from pyspark.sql import Window as W

    dated = cells.where(F.col("value").rlike("^[0-9]{4}(年|[-/.])|[0-9]{4}-[0-9]{2}-[0-9]{2}")).select("source", "sheet", F.col("col").alias("hc"), F.col("row").alias("hr"), F.col("value").alias("header"))
    first = W.partitionBy("source", "sheet", "row").orderBy("col")
    labels = cells.where("value is not null and not value rlike '^[-(]?[0-9]'").withColumn("n", F.row_number().over(first)).where("n = 1").select("source", "sheet", "row", F.col("value").alias("label"))
    numbers = cells.where("value rlike '^[-(]?[0-9][0-9,.]*[)]?$'")
    above = numbers.join(dated, ["source", "sheet"]).where("hc = col and hr < row")
    nearest = above.groupBy("source", "sheet", "row", "col", "address", "value", "formula").agg(F.max_by("header", "hr").alias("header"))
    return nearest.join(labels, ["source", "sheet", "row"]).select("source", "sheet", "row", "col", "address", "label", "header", F.col("value").alias("raw_value"), "formula")


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A SQLite table opened read-only, in row-id ranges that are read in parallel; the file must be on a shared path."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError("not a table name")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {table}").fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    ranges = [(a, min(high, a + step - 1)) for a in range(low, high + 1, step)] or [(0, -1)]
    names = T.StructType.fromDDL(schema).fieldNames()

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in frame.itertuples(index=False):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    yield pd.read_sql_query(f"select {', '.join(names)} from {table} where rowid between ? and ?", db, params=(int(a), int(b)))

    return spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges)).mapInPandas(scan, schema)
