"""Excel workbook (``.xlsx``) source as a Python data source (S3).

Each (file, sheet) is one input partition, read on an executor with the
standard library (``zipfile`` + ``xml.etree``): shared strings, inline
strings, booleans, numbers, and date-formatted numbers (turned into ISO
text).  A sheet holds at most 1 048 576 rows, so a partition is bounded; a
folder of workbooks is read by as many tasks as it has sheets.  Values arrive
as text and get types from the same one-aggregate inference as CSV.

``write_workbooks`` writes one workbook per Spark partition (used to turn a
table into workbooks, e.g. for round trips).
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from tablelens.sources.files import NA_TOKENS, _missing_to_null, apply_types, infer_types, stem_name
from tablelens.functions.columns import qcol

NS = {
    "m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "pr": "http://schemas.openxmlformats.org/package/2006/relationships",
}
# Built-in number formats that display dates or times.
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
EXCEL_EPOCH = dt.datetime(1899, 12, 30)
MAX_SHEET_ROWS = 1_048_575  # data rows per sheet besides the header
SOURCE_NAME = "tablelens_workbook"


# --------------------------------------------------------------------------
# reading one workbook (runs on executors)
# --------------------------------------------------------------------------

def _sheet_targets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, member path)`` in workbook order."""
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", NS)}
    out = []
    for s in wb.findall("m:sheets/m:sheet", NS):
        rid = s.get(f"{{{NS['r']}}}id")
        t = target[rid].lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return out


def list_sheets(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [n for n, _ in _sheet_targets(z)]


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root.findall("m:si", NS)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in root.findall("m:numFmts/m:numFmt", NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[dmyhs]", code))
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in DATE_FORMAT_IDS or custom.get(fid, False):
            out.add(i)
    return out


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _excel_date(v: str) -> str:
    x = float(v)
    d = EXCEL_EPOCH + dt.timedelta(days=x)
    if x == int(x):
        return d.date().isoformat()
    return d.isoformat(sep=" ")


def iter_sheet_rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """Rows of one sheet as lists of text (``None`` for empty cells)."""
    with zipfile.ZipFile(path) as z:
        member = dict(_sheet_targets(z))[sheet]
        strings = _shared_strings(z)
        dates = _date_styles(z)
        with z.open(member) as fh:
            row: dict[int, str | None] = {}
            in_row = False
            for event, el in ET.iterparse(fh, events=("start", "end")):
                tag = el.tag.rsplit("}", 1)[-1]
                if event == "start" and tag == "row":
                    row, in_row = {}, True
                elif event == "end" and tag == "c" and in_row:
                    t = el.get("t")
                    ref = el.get("r") or ""
                    idx = _col_index(ref) if ref else len(row)
                    v = el.find("m:v", NS)
                    if t == "inlineStr":
                        val = "".join(x.text or "" for x in el.iter(f"{{{NS['m']}}}t"))
                    elif v is None or v.text is None:
                        val = None
                    elif t == "s":
                        val = strings[int(v.text)]
                    elif t == "b":
                        val = "True" if v.text.strip() == "1" else "False"
                    elif t in ("str", "e"):
                        val = v.text
                    elif int(el.get("s", "0")) in dates:
                        val = _excel_date(v.text)
                    else:
                        val = v.text
                    row[idx] = val
                    el.clear()
                elif event == "end" and tag == "row":
                    width = max(row) + 1 if row else 0
                    yield [row.get(i) for i in range(width)]
                    in_row = False
                    el.clear()


def sheet_header(path: str, sheet: str) -> list[str]:
    """Header row; empty names become ``Unnamed: i`` and repeated names get
    ``.1``, ``.2`` suffixes, so every column name is unique."""
    for r in iter_sheet_rows(path, sheet):
        names, seen = [], {}
        for i, c in enumerate(r):
            name = ("" if c is None else str(c)) or f"Unnamed: {i}"
            if name in seen:
                seen[name] += 1
                name = f"{name}.{seen[name]}"
            else:
                seen[name] = 0
            names.append(name)
        return names
    return []


# --------------------------------------------------------------------------
# Python data source
# --------------------------------------------------------------------------

class _SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__((path, sheet))
        self.path = path
        self.sheet = sheet


class WorkbookDataSource(DataSource):
    """Options: ``paths`` (JSON list of files), ``sheet`` (name).  The caller
    passes the all-text schema of the header row."""

    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> StructType:
        paths = json.loads(self.options["paths"])
        header = sheet_header(paths[0], self.options["sheet"]) if paths else []
        return StructType([StructField(h, StringType(), True) for h in header])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(json.loads(self.options["paths"]), self.options["sheet"], len(schema.fields))


class _WorkbookReader(DataSourceReader):
    def __init__(self, paths: list[str], sheet: str, width: int):
        self.paths = paths
        self.sheet = sheet
        self.width = width

    def partitions(self):
        return [_SheetPartition(p, self.sheet) for p in self.paths]

    def read(self, partition):
        first = True
        for r in iter_sheet_rows(partition.path, partition.sheet):
            if first:  # header row
                first = False
                continue
            r = (list(r) + [None] * self.width)[: self.width]
            yield tuple(r)


_REGISTERED: set[int] = set()


def _ensure_registered(spark: SparkSession) -> None:
    key = id(spark)
    if key not in _REGISTERED:
        spark.dataSource.register(WorkbookDataSource)
        _REGISTERED.add(key)


def read_sheet(spark: SparkSession, paths: str | list[str], sheet: str, infer: bool = True,
               stage: bool = True) -> DataFrame:
    """One sheet of one or many workbooks (same header) as a typed table."""
    from tablelens.session import local_path

    files = sorted(glob.glob(local_path(paths))) if isinstance(paths, str) else [local_path(p) for p in paths]
    from tablelens.session import ship_package

    ship_package(spark)
    _ensure_registered(spark)
    raw = spark.read.format(SOURCE_NAME).option("paths", json.dumps(files)).option("sheet", sheet).load()
    cleaned = raw.select(*[_missing_to_null(qcol(c), NA_TOKENS).alias(c) for c in raw.columns])
    if not infer:
        return cleaned
    if stage:
        # Sheets are parsed once, in Python; the text rows are written below
        # the checkpoint folder so inference and the typed read both scan the
        # columnar copy instead of parsing the workbooks twice.
        from tablelens.session import materialize

        cleaned = materialize(cleaned)
    return apply_types(cleaned, infer_types(cleaned))


def read_workbooks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: every sheet of a workbook as table ``<stem>_<sheet>``."""
    stem = stem_name(path)
    out = {}
    for sheet in list_sheets(path):
        out[f"{stem}_{sheet.replace(' ', '_').replace('-', '_')}"] = read_sheet(spark, [path], sheet)
    return out


# --------------------------------------------------------------------------
# writing: one workbook per Spark partition
# --------------------------------------------------------------------------

def _col_letter(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and not (isinstance(v, float) and v != v):
        return f'<c r="{ref}"><v>{repr(v)}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook_bytes(sheets: list[tuple[str, list[str], list[tuple]]]) -> bytes:
    """A minimal ``.xlsx`` with inline strings; ``sheets`` = (name, header, rows)."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        overrides = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" '
            'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            for i in range(len(sheets))
        )
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   f"{overrides}</Types>")
        z.writestr("_rels/.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                   "</Relationships>")
        sheet_tags = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _, _) in enumerate(sheets)
        )
        z.writestr("xl/workbook.xml",
                   '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f"<sheets>{sheet_tags}</sheets></workbook>")
        rels = "".join(
            f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            f'Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))
        )
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f"{rels}</Relationships>")
        for i, (_, header, rows) in enumerate(sheets):
            lines = []
            for r_i, r in enumerate([tuple(header)] + [tuple(x) for x in rows]):
                cells = "".join(_cell(f"{_col_letter(c)}{r_i + 1}", v) for c, v in enumerate(r))
                lines.append(f'<row r="{r_i + 1}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                       f"<sheetData>{''.join(lines)}</sheetData></worksheet>")
    return buf.getvalue()


def write_workbooks(df: DataFrame, out_dir: str, sheet: str) -> DataFrame:
    """Write each partition of ``df`` as ``part-<partition>-<chunk>.xlsx``
    files with one sheet each (a new file every ``MAX_SHEET_ROWS`` rows);
    returns a frame of the written paths (evaluate it to write)."""
    from tablelens.session import local_path

    out_dir = local_path(out_dir)
    import uuid

    from tablelens.session import ship_package

    ship_package(df.sparkSession)
    header = df.columns

    def flush(rows, chunk):
        # named by partition and chunk, written under a temporary name and
        # renamed: a retried task replaces its file instead of adding one
        from pyspark import TaskContext

        os.makedirs(out_dir, exist_ok=True)
        pid = TaskContext.get().partitionId()
        path = os.path.join(out_dir, f"part-{pid:05d}-{chunk:03d}.xlsx")
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as fh:
            fh.write(workbook_bytes([(sheet, header, rows)]))
        os.replace(tmp, path)
        return path

    def write(it):
        import pandas as pd

        rows, paths, counts = [], [], []
        for pdf in it:
            for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                rows.append(r)
                if len(rows) == MAX_SHEET_ROWS:
                    paths.append(flush(rows, len(paths)))
                    counts.append(len(rows))
                    rows = []
        if rows:
            paths.append(flush(rows, len(paths)))
            counts.append(len(rows))
        if paths:
            yield pd.DataFrame({"path": paths, "rows": counts})

    return df.mapInPandas(write, "path string, rows bigint")
