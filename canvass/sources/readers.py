"""Readers that find out what a file is; the rows are always read by Spark where Spark has a reader."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from canvass.codebook import CodebookError
from canvass.functions.columns import finite

HEAD_BYTES = 1 << 16
MISSING_TOKENS = ("", "na", "n/a", "nan", "null", "none", "?")
ENCODINGS = ("utf-8", "cp932", "shift_jis", "latin-1")
#: Their names in Java where these differ; Spark itself knows the last only.
CHARSETS = {"cp932": "windows-31j", "shift_jis": "Shift_JIS", "latin-1": "iso-8859-1"}
#: Row numbers of a SQLite table in a task, and the most tasks that it is cut into.
RANGE_ROWS, MAX_RANGES = 100_000, 4096


def head(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def detect_format(name: str, start: bytes) -> str:
    """parquet, arrow, sqlite, arff, tsv or csv by magic bytes; the extension only where there are none."""
    if start.startswith(b"PAR1"):
        return "parquet"
    if start.startswith(b"ARROW1"):
        return "arrow"
    if start.startswith(b"SQLite format 3\0"):
        return "sqlite"
    text = start.lstrip(b"\xef\xbb\xbf \t\r\n")
    if text[:9].lower() == b"@relation" or (text.startswith(b"%") and b"@relation" in text.lower()):
        return "arff"
    if name.lower().endswith((".tsv", ".tab")):
        return "tsv"
    line = start.split(b"\n", 1)[0]
    return "tsv" if line.count(b"\t") > line.count(b",") else "csv"


def marked_encoding(start: bytes) -> str | None:
    """The encoding that a byte order mark tells."""
    if start.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    return "utf-16" if start.startswith((b"\xff\xfe", b"\xfe\xff")) else None


def decodes(text: bytes, encoding: str) -> bool:
    try:
        text.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def detect_encoding(text: bytes) -> str:
    """By byte order mark, or the first encoding that reads the whole text."""
    return marked_encoding(text) or next(e for e in ENCODINGS if decodes(text, e))


def scan_lines(spark: SparkSession, path: str, quote: str = '"') -> tuple[str, bool]:
    """The first encoding that reads every line, and whether a quoted field may run over a line's end; one pass in tasks.

    No character of these encodings holds a line break, so lines are tried apart.  A field that runs on leaves an odd
    number of quotes in its first line.  A file with a two-byte order mark is not looked through: its lines run on.
    """
    marked = marked_encoding(head(spark, path, 4))
    if marked == "utf-16":
        return marked, True

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(0)
            text = b"\n".join(lines.to_pylist())
            odd = pc.any(pc.equal(pc.bit_wise_and(pc.count_substring(lines, quote), 1), 1)).as_py() if quote else False
            yield pa.RecordBatch.from_pylist([{"odd": bool(odd)} | {f"e{i}": decodes(text, e) for i, e in enumerate(ENCODINGS)}])

    lines = spark.read.text(path).select(F.col("value").cast("binary"))
    reads = [f"e{i}" for i in range(len(ENCODINGS))]
    found = lines.mapInArrow(look, ", ".join(f"{c} boolean" for c in ("odd", *reads))).agg(F.bool_or("odd"), *(F.bool_and(c) for c in reads)).first()
    return marked or next(e for e, ok in zip(ENCODINGS, found[1:], strict=True) if ok is not False), bool(found[0])


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated headers get _2, _3, ...; empty ones a number."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        base = (n or "").strip() or f"column_{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"', header: bool = True, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """CSV or TSV: blank rows are skipped, a row of another length is an error, missing tokens are null.

    One pass over all lines settles the encoding and whether fields run over lines; where none does, a file is read in
    splits.  Types come from one pass over all rows: long where every value is one (codes with leading zeros stay
    text), else double, else string.  For Japanese encodings the session is set to take Java's names of character sets.
    """
    delimiter = delimiter or ("\t" if detect_format(path, head(spark, path)) == "tsv" else ",")
    told, run_on = scan_lines(spark, path, quote)
    encoding = encoding or told
    encoding = CHARSETS.get(encoding.lower(), encoding)
    if encoding in (CHARSETS["cp932"], CHARSETS["shift_jis"]):
        spark.conf.set("spark.sql.legacy.javaCharsets", True)
    run_on = run_on or encoding.lower().startswith(("utf-16", "utf-32"))
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("encoding", encoding).option("multiLine", run_on).option("escape", quote)
    first = reader.csv(path).limit(1).collect()
    if not first:
        raise CodebookError("the file is empty")
    names = unique_names([str(x or "").lstrip("﻿") for x in first[0]]) if header else [f"column_{i + 1}" for i in range(len(first[0]))]
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = reader.option("header", header).option("enforceSchema", True).option("mode", "FAILFAST").schema(schema).csv(path)
    clean = lambda n: F.when(~F.lower(F.trim(F.col(f"`{n}`"))).isin(*MISSING_TOKENS), F.trim(F.col(f"`{n}`")))
    rows = raw.select(*(clean(n).alias(n) for n in names))
    return typed(rows) if infer else rows


def typed(rows: DataFrame) -> DataFrame:
    """String columns as long or double where every value allows it."""
    tests = []
    for n in rows.columns:
        c = F.col(f"`{n}`")
        zeros = c.rlike(r"^[+-]?0[0-9]+$")
        tests += [F.count_if(c.isNotNull() & (c.try_cast("long").isNull() | zeros)), F.count_if(c.isNotNull() & (c.try_cast("double").isNull() | zeros)), F.count(c)]
    found = rows.agg(*(t.alias(f"t{i}") for i, t in enumerate(tests))).first()
    out = []
    for i, n in enumerate(rows.columns):
        not_long, not_double, some = found[3 * i : 3 * i + 3]
        kind = "string" if not some or not_double else "double" if not_long else "long"
        out.append(F.col(f"`{n}`").try_cast(kind).alias(n))
    return rows.select(*out)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF with dense or sparse rows: the header up to @data, however long, the rows in parallel."""
    names, kinds = [], []
    n = 1 << 20
    while len(start := head(spark, path, n)) == n and not re.search(rb"(?im)^\s*@data", start):
        n *= 4
    for line in start.decode("utf-8", "replace").splitlines():
        words = line.strip()
        if words[:10].lower() == "@attribute":
            rest = words[10:].strip()
            mark = rest[:1]
            name, kind = rest[1:].split(mark, 1) if mark in ("'", '"') else (rest.split(None, 1) + [""])[:2]
            names.append(name)
            kinds.append("double" if kind.strip().lower() in ("numeric", "real", "integer") else "string")
        if words[:5].lower() == "@data":
            break
    k = len(names)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for frame in frames:
            out = []
            for line in frame["value"]:
                line = line.strip()
                if not line or line[0] in "%@":
                    continue
                if line[0] == "{":
                    row: list[str | None] = ["0"] * k
                    for item in next(csv.reader([line[1:-1]], quotechar="'", skipinitialspace=True)):
                        at, value = item.strip().split(None, 1)
                        row[int(at)] = value.strip("'\"")
                else:
                    row = next(csv.reader([line], quotechar="'", skipinitialspace=True))
                out.append([None if v.strip() == "?" else v.strip() for v in row])
            yield pd.DataFrame(out, columns=names, dtype=object)

    raw = spark.read.text(path).mapInPandas(parse, ", ".join(f"`{n}` string" for n in names))
    return raw.select(*(F.col(f"`{n}`").try_cast(t).alias(n) for n, t in zip(names, kinds, strict=True)))


def _arrow_file(path: str) -> pa.ipc.RecordBatchFileReader:
    store, name = pa.fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(store.open_input_file(name))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC or Feather file in a folder that all executors see: the driver reads its footer, tasks a record
    batch each.  Dictionary columns come as their values."""
    with _arrow_file(path) as f:
        plain = pa.schema([pa.field(c.name, c.type.value_type if pa.types.is_dictionary(c.type) else c.type) for c in f.schema])
        n = f.num_record_batches
    schema = from_arrow_schema(plain, prefer_timestamp_ntz=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        with _arrow_file(path) as f:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    columns = f.get_batch(i).columns
                    yield pa.RecordBatch.from_arrays([c.cast(k, safe=False) for c, k in zip(columns, kinds.types, strict=True)], names=kinds.names)

    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, schema)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a database file in a folder that all executors see; columns of numbers only are double.

    Tasks read ranges of its row numbers; a table without row numbers is one range.  One pass finds the types.
    """
    if table not in sqlite_tables(path):
        raise CodebookError(f"no table {table}")
    name = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [d[0] for d in db.execute(f"SELECT * FROM {name} LIMIT 0").description]
        try:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()
            part = "WHERE rowid BETWEEN ? AND ?"
        except sqlite3.OperationalError:
            low, high, part = 0, 0, "WHERE ? <= ?"
    if low is None:
        low, high = 0, 0
    n = min(MAX_RANGES, (high - low) // RANGE_ROWS + 1)
    cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    cursor = db.execute(f"SELECT * FROM {name} {part}", (cuts[i], cuts[i + 1] - 1) if "rowid" in part else (0, 0))
                    while some := cursor.fetchmany(10_000):
                        yield some

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([all(v is None or isinstance(v, (int, float)) for v in c)]) for c in zip(*some, strict=True)], names=[f"c{i}" for i in range(len(names))])

    ranges = spark.range(0, n, 1, n)
    found = ranges.mapInArrow(kinds, ", ".join(f"c{i} boolean" for i in range(len(names)))).agg(*(F.bool_and(f"c{i}") for i in range(len(names)))).first()
    number = [bool(v) for v in found]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows(batches):
            columns = zip(zip(*some, strict=True), number, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else float(v) if num else str(v) for v in c], pa.float64() if num else pa.string()) for c, num in columns], names=names)

    return ranges.mapInArrow(read, ", ".join(f"`{c}` {'double' if num else 'string'}" for c, num in zip(names, number, strict=True)))


def read_any(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    kind = detect_format(path, head(spark, path, 1024))
    readers = {"parquet": spark.read.parquet, "arrow": lambda p: read_arrow(spark, p), "arff": lambda p: read_arff(spark, p), "sqlite": lambda p: read_sqlite(spark, p, table or sqlite_tables(p)[0])}
    return readers.get(kind, lambda p: read_delimited(spark, p))(path)


def sample_flowers(spark: SparkSession, n: int = 150, seed: int = 7) -> DataFrame:
    """A built-in table of three classes and four measures, drawn from a rule."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = i * 3 // n
        m = (5.0 + 0.8 * k, 3.4 - 0.3 * (k > 0), 1.5 + 2.4 * (k > 0) + 1.2 * (k > 1), 0.2 + 1.1 * (k > 0) + 0.7 * (k > 1))
        rows.append((f"ROW-{i + 1:06d}", *(round(float(x + rng.normal(0, 0.3)), 1) for x in m), f"class{k}"))
    return spark.createDataFrame(rows, "__rowId__ string, length double, width double, petal_length double, petal_width double, class string")


def with_row_ids(df: DataFrame, column: str | None = None, order: Column | str | None = None) -> DataFrame:
    """A unique, non-null string key __rowId__ as first column: a given column, one that exists, or numbers by an order."""
    if column is None and "__rowId__" in df.columns:
        column = "__rowId__"
    if column is not None:
        r = df.agg(F.count("*"), F.count(column), F.count_distinct(column)).first()
        if not r[0] == r[1] == r[2]:
            raise CodebookError(f"{column} is not unique or has nulls")
        return df.select(F.col(column).cast("string").alias("__rowId__"), *(c for c in df.columns if c != "__rowId__"))
    if order is None:
        raise CodebookError("numbering rows needs an order")
    from canvass.operators.selection import positions

    key = order if isinstance(order, str) else "__order"
    rows = positions(df if isinstance(order, str) else df.withColumn("__order", order), key)
    return rows.select(F.format_string("ROW-%06d", F.col("position") + 1).alias("__rowId__"), *df.columns)


def schema_probe(df: DataFrame) -> DataFrame:
    """For each column: nulls, distinct values, ends, whether constant and whether it could be a key; one pass."""
    rows = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        number = kind in ("double", "float", "long", "integer", "short", "byte")
        v = finite(c) if number else F.lit(None).cast("double")
        distinct = F.count_distinct(c)
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(kind).alias("type"), (F.count("*") - F.count(c)).alias("n_missing"), distinct.alias("n_distinct"),
                F.min(v).alias("min"), F.max(v).alias("max"), (distinct <= 1).alias("constant"), ((distinct == F.count("*")) & (F.count(c) == F.count("*"))).alias("unique_id"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    g = df.groupBy(column).agg(F.min(order).alias("__first"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("__first")) - 1).drop("__first")
