"""Writing tables and workspaces. Every table sink is a distributed write, one file for each partition, except XLSX."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.names import export_columns
from strata.functions.values import csv_cell, kind_of, label, tsv_cell


def cells(df: DataFrame, guard, derived: bool = True) -> DataFrame:
    """The columns to export; texts guarded against being run as formulas."""
    names = export_columns(df.columns, derived)
    return df.select(*[(guard(label(df, c)) if kind_of(df, c) in ("text", "other") else label(df, c)).alias(c) for c in names])


def delimited(df: DataFrame, path: str, **form: str) -> None:
    """Each file has a byte order mark and the header, so that each is whole; a table without rows gives the header."""
    head = [f"\ufeff{c}" if not k else c for k, c in enumerate(df.columns)]
    options = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **form}
    df.toDF(*head).write.options(**options).csv(path)


def quoted(cell: Column) -> Column:
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def write_csv(df: DataFrame, path: str, derived: bool = True) -> None:
    """Quoted as RFC 4180 has it: lines end with CR LF, and line breaks in cells stay what they are.

    Each file has a byte order mark and the header, so that each is whole; a table without
    rows gives the header.
    """
    table = cells(df, csv_cell, derived)
    blank = F.lit('""' if len(table.columns) == 1 else "")  # else a row without a value would be no line
    line = F.concat_ws(",", *[F.coalesce(quoted(F.col(f"`{c}`").cast("string")), blank) for c in table.columns])
    head = io.StringIO(newline="")
    csv.writer(head, lineterminator="").writerow(table.columns)
    first = "\ufeff" + head.getvalue()

    headed(first, table.select(line.alias("value"))).write.option("lineSep", "\r\n").text(path)


def headed(first: str, lines: DataFrame) -> DataFrame:
    """value: the lines with a first one before each partition's, so that each file is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([first])], ["value"])
        for batch in batches:
            yield pa.record_batch([batch.column(0)], ["value"])

    return lines.mapInArrow(run, "value string")


def write_tsv(df: DataFrame, path: str, derived: bool = True) -> None:
    delimited(cells(df, tsv_cell, derived), path, sep="\t", quote="")


def write_json(df: DataFrame, path: str, derived: bool = True, array: bool = False) -> None:
    """A row object on each line; array: each file is one JSON array, for readers that want a whole document."""
    rows = df.select(*[F.col(f"`{c}`") for c in export_columns(df.columns, derived)])
    if not array:
        rows.write.option("ignoreNullFields", False).json(path)
        return

    def enclosed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of a partition with commas between them, in brackets."""
        held = None
        for batch in batches:
            for line in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(["[" if held is None else f"{held},"])], ["value"])
                held = line
        yield pa.record_batch([pa.array(["[]"] if held is None else [held, "]"])], ["value"])

    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(enclosed, "value string").write.text(path)


def xlsx_bytes(df: DataFrame, most: int = 1_048_575) -> bytes:
    """One sheet; a sheet has no more rows than `most`, and a larger table is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a sheet; write CSV or Parquet")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows])
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


#: Where a session saves itself: a workspace that lists do not show.
SESSION = "_session"


def save_workspace(spark: SparkSession, folder: str, name: str, datasets: list, extra: dict | None = None) -> dict:
    """A new version of a workspace: tables first, then a manifest, and only then what came before is cleared.

    Each table is written once to a folder of its own that no version had before, so a saved
    workspace can be loaded, changed and saved under its own name, and a save that fails
    leaves the last version as it is. A table that is already one of this workspace's and
    unchanged is kept. Manifests are numbered; the last whole one counts.
    """
    home = f"{folder}/{checked(name)}"
    tables: dict[int, str] = {}
    listed = []
    for d in datasets:
        if id(d.df) not in tables:
            tables[id(d.df)] = held(d.df, home) or f"t{uuid.uuid4().hex}"
            if not held(d.df, home):
                d.df.write.parquet(f"{home}/{tables[id(d.df)]}")
        listed.append({"name": d.name, "mode": d.mode, "table": tables[id(d.df)], "conditions": d.conditions, "log": list(d.log)})
    told = {"version": 1, "tables": sorted(set(tables.values())), "datasets": listed} | (extra or {})
    if found := manifest_problems(told):
        raise ValueError("; ".join(found))
    last = (versions(spark, home) or [0])[-1]
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{home}/manifest-{last + 1:09d}")
    return told


def held(df: DataFrame, home: str) -> str | None:
    """The table of a workspace that load_workspace() read df from."""
    home_of, table = getattr(df, "saved_in", (None, None))
    return table if home_of == home else None


def checked(name: str) -> str:
    if not re.fullmatch(r"[\w .-]+", name) or name in (".", ".."):
        raise ValueError("not a workspace's name")
    return name


def versions(spark: SparkSession, home: str) -> list[int]:
    """The numbers of a workspace's whole manifests, in order."""
    fs, path = file_system(spark, home)
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[9:]) for n in names if re.fullmatch(r"manifest-\d{9}", n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{n}/_SUCCESS")))


def cleared(spark: SparkSession, folder: str, name: str, keep: int = 1) -> list[str]:
    """Delete what no manifest but the last `keep` leads to, and tell the names; what is read of older versions ends.

    Call it when no save of this workspace is under way: a table that is being written has no manifest yet.
    """
    home = f"{folder}/{checked(name)}"
    found = versions(spark, home)[-keep:]
    if not found:
        return []
    live = {f"manifest-{v:09d}" for v in found} | {t for v in found for t in manifest(spark, folder, name, v)["tables"]}
    fs, path = file_system(spark, home)
    gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in live and re.fullmatch(r"manifest-\d{9}|t[0-9a-f]{32}", f.getPath().getName())]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def save_session(spark: SparkSession, folder: str, datasets: list, extra: dict | None = None) -> bool:
    """The session as it is now, for the next start; False, and nothing is changed, if it could not be saved."""
    try:
        save_workspace(spark, folder, SESSION, datasets, extra)
        cleared(spark, folder, SESSION, keep=2)  # what this session still reads
        return True
    except (Py4JJavaError, PySparkException):
        return False


def load_session(spark: SparkSession, folder: str) -> list:
    """The datasets of the last saved session; none if there is none or it cannot be read."""
    try:
        return load_workspace(spark, folder, SESSION) if versions(spark, f"{folder}/{SESSION}") else []
    except (Py4JJavaError, PySparkException, ValueError):
        return []


def clear_session(spark: SparkSession, folder: str) -> bool:
    return delete_workspace(spark, folder, SESSION)


def list_workspaces(spark: SparkSession, folder: str) -> list[dict]:
    """name, datasets and saved (milliseconds since 1970) of the workspaces in a folder, the latest first."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    out = []
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        if name != SESSION and f.isDirectory() and (found := versions(spark, f"{folder}/{name}")):
            m, at = manifest(spark, folder, name, found[-1]), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/manifest-{found[-1]:09d}")
            out.append({"name": name, "datasets": [d["name"] for d in m["datasets"]], "saved": fs.getFileStatus(at).getModificationTime()})
    return sorted(out, key=lambda w: (-w["saved"], w["name"]))


def delete_workspace(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether there was one. Only a folder with a manifest is deleted."""
    fs, path = file_system(spark, f"{folder}/{checked(name)}")
    return bool(versions(spark, f"{folder}/{name}") and fs.delete(path, True))


def file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str, name: str, version: int | None = None) -> dict:
    """A workspace's checked manifest, the last one if no version is named."""
    home = f"{folder}/{checked(name)}"
    found = versions(spark, home)
    if not found or version is not None and version not in found:
        raise ValueError(f"no such workspace: {name}")
    m = json.loads(spark.read.text(f"{home}/manifest-{version or found[-1]:09d}", wholetext=True).first()["value"])
    if found := manifest_problems(m):
        raise ValueError("; ".join(found))
    return m


def manifest_problems(m) -> list[str]:
    """What is wrong with a manifest's structure."""
    if isinstance(m, dict) and isinstance(m.get("version"), int) and m["version"] > 1:
        return ["the workspace was saved by a newer version"]
    if not isinstance(m, dict) or m.get("version") != 1:
        return ["not a workspace of version 1"]
    tables, out = m.get("tables"), []
    if isinstance(tables, dict):  # rows inline, by name
        if not all(isinstance(t, list) and all(isinstance(r, dict) for r in t) for t in tables.values()):
            return ["an inline table must be a list of rows"]
    elif not isinstance(tables, list) or not all(isinstance(t, str) and t.isalnum() for t in tables):
        return ["tables must be a list of names"]
    if not isinstance(m.get("datasets"), list):
        return ["datasets must be a list"]
    for d in m["datasets"]:
        if not isinstance(d, dict) or not isinstance(d.get("name"), str) or d.get("table") not in tables:
            out.append("a dataset lacks its name or table")
    return out


def load_workspace(spark: SparkSession, folder: str, name: str, version: int | None = None) -> list:
    """The datasets of a workspace; those that were saved with one table share it."""
    from strata.plans.dataset import Dataset
    from strata.plans.policy import mode_of

    m, home, tables = manifest(spark, folder, name, version), f"{folder}/{name}", {}
    for t in m["tables"]:
        tables[t] = spark.read.parquet(f"{home}/{t}")
        tables[t].saved_in = (home, t)
    return [Dataset(tables[d["table"]], d["name"], mode_of(d.get("mode")), d.get("conditions", []), tuple(d.get("log", []))) for d in m["datasets"]]


def import_workspace(spark: SparkSession, path: str) -> list:
    """The datasets of a workspace file with its tables inline: {"version": 1, "tables": {name: [row objects]}, "datasets": [{"name", "table"}]}.

    Such a file is one small document, which is checked on the driver; its tables get a row
    number and are in the value domain from then on.
    """
    from strata.functions.values import normalised
    from strata.operators.transfer import numbered
    from strata.plans.dataset import Dataset
    from strata.plans.policy import mode_of

    try:
        m = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except json.JSONDecodeError as e:
        raise ValueError("not a workspace file") from e
    if found := manifest_problems(m):
        raise ValueError("; ".join(found))
    if not isinstance(m["tables"], dict):
        raise ValueError("the file has no tables of its own")

    def table(rows: list[dict]) -> DataFrame:
        names = list(dict.fromkeys(c for r in rows for c in r if c != "_row"))
        texts = {c for c in names if any(isinstance(r.get(c), str) for r in rows)}
        cell = lambda c, v: v if v is None or isinstance(v, str) else (json.dumps(v) if c in texts else float(v))
        data = [tuple(cell(c, r.get(c)) for c in names) for r in rows]
        return numbered(normalised(spark.createDataFrame(data, ", ".join(f"`{c}` {'string' if c in texts else 'double'}" for c in names))))

    tables = {t: table(rows) for t, rows in m["tables"].items()}
    return [Dataset(tables[d["table"]], d["name"], mode_of(d.get("mode")), d.get("conditions", []), tuple(d.get("log", []))) for d in m["datasets"]]


def estimated_bytes(n_rows: int, n_columns: int) -> int:
    return 12 * n_rows * n_columns


def provenance_text(dataset) -> str:
    return "\n".join([f"{dataset.name} ({dataset.mode})", *[f"{k + 1}. {x}" for k, x in enumerate(dataset.log)]])
