"""Exports, fingerprints and the revisioned store."""

from __future__ import annotations

import json
import math
import uuid
import zipfile
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.codebook import Codebook, CodebookError
from canvass.operators.summaries import labelled

MAX_XLSX_ROWS = 1_048_575


def neutral(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe; numbers stay."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & c.try_cast("double").isNull(), F.concat(F.lit("'"), c)).otherwise(c)


def for_export(df: DataFrame, book: Codebook | None = None, labels: Sequence[str] = ()) -> DataFrame:
    out = labelled(df, book, labels) if book and labels else df
    return out.select(*(neutral(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in out.schema.fields))


def write_csv(df: DataFrame, path: str, **how) -> None:
    for_export(df, **how).write.option("header", True).option("escape", '"').csv(path)


def write_xlsx(df: DataFrame, path: str, **how) -> None:
    """A workbook of one sheet, row by row from an iterator; the format itself ends at MAX_XLSX_ROWS rows."""
    out = for_export(df, **how)

    def cell(v: object) -> str:
        if v is None or (isinstance(v, float) and not math.isfinite(v)):
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(("<row>" + "".join(map(cell, out.columns)) + "</row>").encode())
            for i, r in enumerate(out.toLocalIterator()):
                if i == MAX_XLSX_ROWS:
                    raise CodebookError("more rows than a workbook holds")
                f.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")


def fingerprint(df: DataFrame) -> DataFrame:
    """A digest of a table's values that does not depend on the order of rows, as one row."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s")).select(
        F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("fingerprint"), "n"
    )


@dataclass(frozen=True)
class Operation:
    revision: int
    kind: str
    params: dict
    parent: int | None
    folder: str


class Store:
    """A dataset as Parquet folders, one a revision, with a log of operations; undo and redo move a cursor."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self) -> dict:
        logs = [s.getPath() for s in self._fs.globStatus(self._path(f"{self.folder}/log-*.json")) or []]
        if not logs:
            return {"version": 0, "operations": [], "cursor": None, "redo": []}
        stream = self._fs.open(max(logs, key=lambda p: p.getName()))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, log: dict) -> None:
        """The next version of the log as a file of its own, renamed when it is whole: no moment is without a log, and of
        two writers one fails."""
        version = log["version"] + 1
        temporary = self._path(f"{self.folder}/_log-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(log | {"version": version}).encode()))
        out.close()
        final = self._path(f"{self.folder}/log-{version:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise CodebookError("the dataset has changed meanwhile")

    def commit(self, df: DataFrame, kind: str, expected: int | None = None, **params: object) -> int:
        """Write a new revision; expected is the one it was made from."""
        log = self._read()
        if expected is not None and expected != log["cursor"]:
            raise CodebookError("the dataset has changed meanwhile")
        revision = len(log["operations"])
        name = f"revision-{revision}-{uuid.uuid4().hex}"  # of this writer alone
        df.write.parquet(f"{self.folder}/{name}")
        log["operations"].append(asdict(Operation(revision, kind, params, log["cursor"], name)))
        self._write(log | {"cursor": revision, "redo": []})
        return revision

    def load(self, revision: int | None = None) -> DataFrame:
        log = self._read()
        at = log["cursor"] if revision is None else revision
        if at is None:
            raise CodebookError("the dataset is empty")
        return self.spark.read.parquet(f"{self.folder}/{log['operations'][at]['folder']}")

    def undo(self) -> int:
        log = self._read()
        parent = log["operations"][log["cursor"]]["parent"] if log["cursor"] is not None else None
        if parent is None:
            raise CodebookError("nothing to undo")
        self._write(log | {"redo": [*log["redo"], log["cursor"]], "cursor": parent})
        return parent

    def redo(self) -> int:
        log = self._read()
        if not log["redo"]:
            raise CodebookError("nothing to redo")
        at = log["redo"][-1]
        self._write(log | {"redo": log["redo"][:-1], "cursor": at})
        return at

    def history(self) -> list[dict]:
        return self._read()["operations"]
