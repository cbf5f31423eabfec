"""Reading tables: CSV, Parquet, XLSX, by extension; warnings as rows."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.values import label, normalised, number, parsed_bare, pattern
from strata.session import removed, written
from strata.sources.records import begun, line_end, lines, records, scanned

#: Bytes of a workbook, which is read on the driver; files that Spark reads have no limit.
LARGEST_WORKBOOK = 250 * 1024 * 1024
#: How many lines with a fault a warning lists.
LISTED = 5


def unique_names(header: list[str | None]) -> tuple[list[str], list[int], list[str]]:
    """Names without repeats, the places kept (blank headers are dropped), and warnings."""
    names, places, said = [], [], []
    for k, raw in enumerate(header):
        name = (raw or "").strip().lstrip("﻿")
        if not name:
            said.append(f"column {k + 1} has no header and is left out")
            continue
        new, n = name, 1
        while new in names:
            new, n = f"{name}_{n}", n + 1
        if new != name:
            said.append(f'a second "{name}" is called "{new}"')
        names.append(new)
        places.append(k)
    return names, places, said


def looks_headerless(names: list[str]) -> bool:
    return len(names) > 1 and all(re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", n) for n in names)


def delimiter_of(line: str) -> str | None:
    """The commonest of comma, tab, semicolon and bar outside quotes; None if there is none."""
    bare = re.sub(r'"[^"]*"', "", line)
    best = max(",\t;|", key=bare.count)
    return best if bare.count(best) else None


def fields_of(line: str, separator: str) -> list[str]:
    """The cells of one line or record."""
    return next(csv.reader(io.StringIO(line, newline=""), delimiter=separator), [])


def line_faults(spark: SparkSession, path: str, separator: str, width: int) -> DataFrame:
    """file, block, n_lines, first (place of the first line), few, many and open: lines with fewer or more
    fields than width, or with an odd number of quotes, for each block of a file."""
    rows = with_faults(lines(spark, path, line_end(spark, path)), separator, width)
    return rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.min("place").alias("first"), *[F.count_if(c).alias(c) for c in FAULTS])


FAULTS = ["few", "many", "open"]


def with_faults(rows: DataFrame, separator: str, width: int) -> DataFrame:
    """rows with whether a line or record (value) has too few fields, too many, or an odd number of quotes. Blank ones have no faults.

    Each step is a column of its own, so that it is taken once; only lines with a quote are searched for quoted cells.
    """
    bare = F.when(F.col("value").contains('"'), F.regexp_replace("value", r'"[^"]*+(?:""[^"]*+)*+"', "q")).otherwise(F.col("value"))
    cut = rows.withColumn("_bare", bare).withColumn("_rest", F.replace("_bare", F.lit(separator), F.lit("")))
    told = cut.withColumn("_blank", F.trim(F.translate("_rest", "\r\n", "")) == "")
    told = told.withColumn("_n", F.expr(f"(length(_bare) - length(_rest)) div {len(separator)} + 1"))
    return told.withColumns({"few": ~F.col("_blank") & (F.col("_n") < width), "many": ~F.col("_blank") & (F.col("_n") > width), "open": F.col("_bare").contains('"')}).drop("_bare", "_rest", "_blank", "_n")


def line_numbers(rows: DataFrame, blocks: DataFrame) -> list[int]:
    """Numbers, from 1 in their file, of the first LISTED of the lines that rows (file, block, place) begin at."""
    order = ["file", "block", "place"]
    own = rows.select(*order).orderBy(*order).limit(LISTED).join(blocks.select("file", "block", "first"), ["file", "block"])
    before = F.broadcast(own).join(blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), "n_lines"), (F.col("f") == F.col("file")) & (F.col("b") < F.col("block")), "left")
    found = before.groupBy(*order, "first").agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n"))
    return [r["n"] + r["place"] - r["first"] + 1 for r in found.orderBy(*order).collect()]


def ragged(rows: DataFrame, blocks: DataFrame, separator: str, width: int, few: int, many: int) -> list[str]:
    """Warnings about so many lines or records with fewer or more fields than the header."""
    said = []
    for n, fault, what, then in ((many, "many", "more", "the extra values were discarded"), (few, "few", "fewer", "the missing values are blank")):
        if n:
            found = line_numbers(with_faults(rows, separator, width).where(fault), blocks)
            said.append(f"{n} row(s) had {what} values than the header has columns (line {', '.join(map(str, found))}{', …' if n > len(found) else ''}); {then}")
    return said


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> tuple[DataFrame, list[str]]:
    """A table in the value domain (a column with a number in it and no other text is double), and warnings.

    Only the header, counts and the numbers of a few lines come to the driver; the body is
    one lazy scan, in as many tasks as the file has blocks, also where cells hold line breaks.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    said = []
    line = first[0]["value"]
    found = separator or delimiter_of(line)
    if found is None:
        said.append("no delimiter was found; a comma is assumed")
    found = found or ","
    form = {"sep": found, "escape": '"', "mode": "PERMISSIVE"}
    width = len(fields_of(line, found))
    blocks = written(line_faults(spark, path, found, width), "lines")
    one = blocks.agg(*[F.sum(c).alias(c) for c in ("few", "many", "open")]).first()
    end = line_end(spark, path)
    rows = lines(spark, path, end)
    broken = None
    if one["open"]:  # a line may end inside quotes
        states = written(begun(scanned(rows, found)), "states")
        if states.where("spans").limit(1).count():
            broken = states
    if broken is None:
        header = fields_of(line, found)
        said += ragged(rows, blocks, found, width, one["few"], one["many"])
    else:
        rows, unclosed = records(rows, found, end, broken)
        top = rows.where("block = 0").orderBy("file", "block", "place").limit(1).first()["value"]  # a file's first record begins in its first block
        header = fields_of(top, found)
        width = len(header)
        one = with_faults(rows, found, width).agg(F.count_if("few").alias("few"), F.count_if("many").alias("many")).first()
        said += [f"an unclosed quotation mark near line {n}: what follows is read as one value" for n in line_numbers(unclosed, broken)[:1]]
        said += ragged(rows, broken, found, width, one["few"], one["many"])
    removed(blocks)
    names, places, more = unique_names(header)
    said += more
    if looks_headerless(names):
        said.append("all headers are numbers; the first row may be data")
    schema = ", ".join(f"`_{k}` string" for k in range(len(header)))
    if broken is None:
        body = spark.read.csv(path, header=True, schema=schema, multiLine=False, enforceSchema=True, **form)
    else:
        tops = broken.where("block = 0").select("file", "block", F.col("first").alias("place"))
        body = rows.join(tops, ["file", "block", "place"], "left_anti").where(F.col("value") != "").select(F.from_csv("value", schema, form).alias("_r")).select("_r.*")
    table = body.select(*[F.col(f"_{k}").alias(n) for k, n in zip(places, names)])
    if not names:
        return table, said
    table = table.where(F.trim(F.concat_ws("", *[F.col(f"`{n}`") for n in names])) != "")
    numbers, more = column_kinds(table)
    return table.select(*[(number(table, c) if c in numbers else label(table, c)).alias(c) for c in table.columns]), said + more


def column_kinds(table: DataFrame) -> tuple[set[str], list[str]]:
    """The text columns that hold numbers only, and warnings about those without a number whose cells
    are mostly (80 %) numbers written with separators or signs; one pass."""
    cells = table.select(*[label(table, c).alias(f"t{k}") for k, c in enumerate(table.columns)])
    cells = cells.select("*", *[parsed_bare(F.col(f"t{k}")).alias(f"n{k}") for k in range(len(table.columns))])
    # A number's pattern is not asked for: where there is a number, the warning does not arise.
    parts = [F.struct(F.count(f"n{k}").alias("numbers"), F.count(f"t{k}").alias("cells"), F.count(F.when(F.col(f"n{k}").isNull(), pattern(F.col(f"t{k}")))).alias("formatted")).alias(f"c{k}") for k in range(len(table.columns))]
    one = dict(zip(table.columns, cells.agg(*parts).first()))
    numbers = {c for c, r in one.items() if r["cells"] and r["numbers"] == r["cells"]}
    return numbers, [f'"{c}" holds formatted numbers and is read as text' for c, r in one.items() if r["cells"] and not r["numbers"] and r["formatted"] >= 0.8 * r["cells"]]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if not df.limit(1).count():
        raise ValueError("the file has no rows")
    return df


MAIN, REL, PACK = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}", "{http://schemas.openxmlformats.org/package/2006/relationships}"


class Workbook:
    """The sheets of an XLSX file, read with the standard library."""

    def __init__(self, data: bytes):
        if len(data) > LARGEST_WORKBOOK:
            raise ValueError("the workbook is too large; save it as CSV or Parquet")
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels").iter(f"{PACK}Relationship")}
        self.sheets = {s.get("name"): "xl/" + links[s.get(f"{REL}id")].removeprefix("/xl/") for s in book.iter(f"{MAIN}sheet")}
        self.texts = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._date_styles()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        styles = self._xml("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        formats = styles.find(f"{MAIN}cellXfs")
        ids = [x.get("numFmtId") for x in formats] if formats is not None else []
        return {k for k, i in enumerate(ids) if i and (14 <= int(i) <= 22 or re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")).lower()))}

    def rows(self, sheet: str) -> list[list]:
        out = []
        for r in self._xml(self.sheets[sheet]).iter(f"{MAIN}row"):
            cells: list = []
            for c in r.iter(f"{MAIN}c"):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r", "")) and re.match("[A-Z]+", c.get("r"))[0] or "":
                    at = at * 26 + ord(letter) - 64
                at = at - 1 if at else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(self._cell(c))
            out.append(cells)
        return [r for r in out if any(v is not None for v in r)]

    def _cell(self, c):
        kind, v = c.get("t"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{MAIN}t")) or None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.texts[int(v.text)] or None
        if kind in ("str", "e"):
            return v.text if kind == "str" else None
        if kind == "b":
            return float(v.text)
        if int(c.get("s", 0)) in self.dates:
            return (datetime(1899, 12, 30) + timedelta(days=float(v.text))).isoformat(timespec="milliseconds") + "Z"
        return float(v.text)


def workbook_bytes(spark: SparkSession, path: str) -> bytes:
    """A file's bytes through Spark, so that any store it can read will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def list_sheets(spark: SparkSession, path: str) -> list[dict]:
    book = Workbook(workbook_bytes(spark, path))
    return [{"sheet": s, "rows": max(0, len(r) - 1), "columns": max(map(len, r), default=0)} for s in book.sheets for r in [book.rows(s)]]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, list[str]]:
    """The named sheet, else the first with data."""
    book = Workbook(workbook_bytes(spark, path))
    if sheet is not None and sheet not in book.sheets:
        raise ValueError(f"no such sheet; there are {', '.join(book.sheets)}")
    name = sheet or next((s for s in book.sheets if len(book.rows(s)) > 1), next(iter(book.sheets)))
    rows = book.rows(name)
    if len(rows) < 2:
        raise ValueError("the sheet has no rows")
    header = [None if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in rows[0]]
    if sum(any(ord(ch) < 32 for ch in h or "") for h in header) * 2 >= len(header):
        raise ValueError("the headers are no text; is this a workbook?")
    names, places, said = unique_names(header)
    if sheet is None and len(book.sheets) > 1:
        said.append(f'"{name}" is read; there are also {", ".join(s for s in book.sheets if s != name)}')
    cells = [[r[p] if p < len(r) else None for p in places] for r in rows[1:]]
    text = [any(isinstance(r[k], str) for r in cells) for k in range(len(names))]
    data = [tuple(None if v is None else (str(v) if t and not isinstance(v, float) else (f"{v:g}" if t else v)) for v, t in zip(r, text)) for r in cells]
    schema = ", ".join(f"`{n}` {'string' if t else 'double'}" for n, t in zip(names, text))
    return normalised(spark.createDataFrame(data, schema)), said


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, list[str]]:
    """By extension."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "tsv", "txt"):
        return read_csv(spark, path, "\t" if end == "tsv" else None)
    if end in ("xlsx", "xlsm"):
        return read_xlsx(spark, path, sheet)
    if end == "parquet":
        return read_parquet(spark, path), []
    raise ValueError(f'"{end}" files are not read; use CSV, XLSX or Parquet')
