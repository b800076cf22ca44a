"""Readers for landed files: NDJSON, CSV, mixed formats, gzip, documents, pages, text trees, notebooks, tables."""
from __future__ import annotations

import csv
import io
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.functions.ignore import Check, ignored, read_rules
from millrace.session import cut

CSV_ROWS = 10_000


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None, max_rows: int = 0) -> DataFrame:
    """One JSON object per line; blank and malformed lines are skipped. Give a schema to spare the inference scan."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.limit(max_rows) if max_rows else df


def read_csv(spark: SparkSession, path: str, header: bool = True, max_rows: int = 0) -> DataFrame:
    """Text columns under trimmed header names; columns without a name are dropped, short rows padded with null."""
    df = spark.read.option("header", header).option("mode", "PERMISSIVE").option("multiLine", False).csv(path)
    if header:
        named = [c for i, c in enumerate(df.columns) if c.strip() and c != f"_c{i}"]
        df = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in named])
    return df.limit(max_rows) if max_rows else df


# Format by file ending.
ENDINGS = {"json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "csv": "csv", "tsv": "csv", "txt": "text"}


def sniff(head: Column, path: Column) -> Column:
    """json, ndjson, csv or text: by the first bytes, else by the file ending."""
    body = F.ltrim(F.regexp_replace(head, "^﻿", ""))
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    several = (F.size(lines) > 1) & F.try_parse_json(F.get(lines, F.lit(0))).isNotNull()
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:\.gz)?$", 1))
    table = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    return (
        F.when(body.startswith("{") & (several | (ending == "ndjson")), "ndjson")
        .when(body.startswith("{") | body.startswith("["), "json").otherwise(F.coalesce(F.try_element_at(table, ending), F.lit("text")))
    )


def file_formats(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, length, format). Content is looked at file by file inside the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length > 0")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", "length", sniff(F.coalesce(text, F.lit("")), F.col("path")).alias("format"))


def read_any(spark: SparkSession, root: str) -> DataFrame:
    """All readable files below a folder as one ragged table (text columns in the order of their names), each by its own format.

    Files are read, sniffed and parsed inside the tasks; neither their names nor their rows pass through the driver, only the
    names of the columns do. A file is one row while it is parsed, so files should fit a task. Nested values stay JSON text;
    lines that are no JSON object are skipped; a CSV file has a header, columns without a name are dropped. A folder without a
    readable file is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length > 0")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    known = files.select(sniff(text, F.col("path")).alias("format"), F.regexp_replace(text, "^\ufeff", "").alias("body"))
    record = "map<string,string>"
    trimmed = F.trim("body")
    whole = F.when(trimmed.startswith("["), F.from_json(trimmed, f"array<{record}>")).otherwise(F.array(F.from_json(trimmed, record)))
    lines = F.transform(F.split("body", r"\r?\n"), lambda x: F.from_json(x, record))
    by_json = known.where("format in ('json', 'ndjson')").select(F.explode(F.when(F.col("format") == "json", whole).otherwise(lines)).alias("row"))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf["body"]:
                rows = csv.DictReader(io.StringIO(body, newline=""), restkey="")
                part = [{k.strip(): v for k, v in row.items() if k and k.strip()} for row in rows]
                for at in range(0, len(part), CSV_ROWS):
                    yield pd.DataFrame({"row": part[at : at + CSV_ROWS]})

    by_csv = known.where("format = 'csv'").select("body").mapInPandas(tables, f"row {record}")
    rows = cut(by_json.union(by_csv).where("row is not null"), "records")
    names = [r.name for r in rows.select(F.explode(F.map_keys("row")).alias("name")).distinct().collect()]
    if not names:
        raise ValueError(f"no readable file below {root}")
    return rows.select(*[F.try_element_at("row", F.lit(n)).alias(n) for n in sorted(names)])


SLICE = 1 << 18  # bytes of packed content that are unpacked at once


def unpacked(content: pa.BinaryScalar) -> Iterator[bytes | None]:
    """The bytes of a file in parts, of all members where it is gzip; None in the end where a stream breaks off."""
    packed, at, stream = memoryview(content.as_buffer()).cast("B"), 0, None
    if packed[:2] != b"\x1f\x8b":
        yield from (bytes(packed[i:i + SLICE]) for i in range(0, len(packed), SLICE))
        return
    while at < len(packed):
        if stream is None:
            if packed[at:at + 2] != b"\x1f\x8b":
                return
            stream = zlib.decompressobj(wbits=31)
        piece = packed[at:at + SLICE]
        at += len(piece)
        while len(piece) and not stream.eof:
            yield stream.decompress(piece, 4 * SLICE)
            piece = stream.unconsumed_tail
        if stream.eof:
            at, stream = at - len(stream.unused_data), None
    if stream is not None:
        yield stream.flush()
        if not stream.eof:
            yield None


def in_lines(parts: Iterator[bytes | None], most: int) -> Iterator[tuple[bytes | None, bool]]:
    """Parts put together to pieces of about ``most`` bytes that end with a line, and whether the bytes break off with them."""
    held, size, broken = [], 0, False
    for part in parts:
        if part is None:
            broken = True
            break
        end = part.rfind(b"\n") + 1
        if end and size + end >= most:
            yield b"".join([*held, part[:end]]), False
            held, size, part = [], 0, part[end:]
        held.append(part)
        size += len(part)
    if size or broken:
        yield b"".join(held), broken


def gunzip_files(files: DataFrame, limit: int | None = None, piece: int | None = None) -> DataFrame:
    """Adds ``body`` and ``truncated`` to (path, content): gzip content by its magic bytes is unpacked, all members of it,
    up to ``limit`` bytes where one is given. ``truncated`` also marks a stream that breaks off.

    With ``piece``, which takes no limit, a file is one row for each piece of about so many bytes, in order, each cut behind the end of a line, so that
    no task holds a body; ``truncated`` is in the last one. An empty file has no row; where content is no gzip after all, null follows the pieces before.
    """
    if piece and limit is not None:
        raise ValueError("a limit goes with whole bodies only")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("body", T.BinaryType()), T.StructField("truncated", T.BooleanType())])

    def unpack(content: bytes) -> tuple[bytes | None, bool]:
        if content[:2] != b"\x1f\x8b":
            return content[:limit], limit is not None and len(content) > limit
        parts, size, whole = [], 0, True
        try:
            while content[:2] == b"\x1f\x8b":
                left = 0 if limit is None else limit - size  # 0 is no bound
                if limit is not None and left <= 0:
                    return b"".join(parts), True
                stream = zlib.decompressobj(wbits=31)
                parts.append(stream.decompress(content, left))
                size, whole, content = size + len(parts[-1]), stream.eof, stream.unused_data
        except zlib.error:
            return None, False
        return parts[0] if len(parts) == 1 else b"".join(parts), not whole

    def pieces(content: pa.BinaryScalar) -> Iterator[tuple[bytes | None, bool]]:
        try:
            yield from in_lines(unpacked(content), piece)
        except zlib.error:
            yield None, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):  # a batch holds many files; their bodies go on one by one
                for body, cut_off in pieces(content) if piece else [unpack(content.as_py())]:
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([body], pa.binary()), pa.array([cut_off])], ["path", "body", "truncated"])

    return files.select("path", "content").mapInArrow(run, schema)


def read_json_documents(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document per file, with the file it came from."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema else reader).json(root)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_paged_results(spark: SparkSession, root: str, row_schema: str) -> DataFrame:
    """Rows of landed pages (page, size, total, items), up to and with the first short or last page.

    A page after a gap in the numbering does not count. Adds ``page``.
    """
    pages = spark.read.schema(f"page bigint, size bigint, total bigint, items array<{row_schema}>").option("multiLine", True).json(root)
    from pyspark.sql import Window as W

    facts = pages.groupBy("page").agg(F.max("size").alias("size"), F.max("total").alias("total"), F.sum(F.size("items")).alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("page").rowsBetween(W.unboundedPreceding, -1)  # one row per page
    last = (F.col("n") < F.col("size")) | ((F.col("page") + 1) * F.col("size") >= F.col("total"))
    used = facts.withColumn("_stop", F.coalesce(F.max(last).over(before), F.lit(False))).withColumn("_seen", F.count(F.lit(1)).over(before))
    used = used.where(~F.col("_stop") & (F.col("_seen") == F.col("page"))).select("page")
    return pages.join(used, "page").select("page", F.explode("items").alias("e")).select("page", "e.*")


# Folders and file patterns that a scan leaves out.
SKIPPED_FOLDERS = (
    ".git", "target", "node_modules", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "dist", "build", ".idea",
    ".vscode", "coverage", ".coverage", "htmlcov", ".eggs", ".sass-cache", ".cache", "vendor",
)
SKIPPED_FILES = ("*.egg-info", "*.pyc", "*.pyo", "*.log", "*.min.js", "*.min.css", "*.map")


def scan_files(spark: SparkSession, root: str, rules: Sequence[Check] = (), max_size: int | None = None, hidden: bool = False) -> DataFrame:
    """Files below a folder as (path relative to it, modificationTime, length, content).

    Empty files, hidden ones, those above ``max_size`` where one is given, skipped folders and ignored paths are left out before any content
    is read: size and path are known from the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/"))
    path = F.regexp_replace("path", f"^.*?{base}/", "")
    fits = F.col("length") > 0 if max_size is None else F.col("length").between(1, max_size)
    files = files.where(fits).withColumn("path", path)
    steps = F.split("path", "/")
    folders = F.slice(steps, 1, F.size(steps) - 1)
    bad = F.exists(folders, lambda s: s.isin(*SKIPPED_FOLDERS))
    if not hidden:
        bad = bad | F.exists(steps, lambda s: s.startswith("."))
    all_rules = [*rules, *read_rules(SKIPPED_FILES)]
    return files.where(~bad & ~ignored(F.col("path"), all_rules))


def read_text_corpus(spark: SparkSession, root: str, rules: Sequence[Check] = (), max_size: int | None = None) -> DataFrame:
    """Text files as (path, size_bytes, text): decoded as UTF-8 without byte order mark, binary files left out."""
    files = scan_files(spark, root, rules, max_size)
    body = F.make_valid_utf8(F.col("content").cast("string"))
    kept = files.where(F.instr(F.col("content"), F.unhex(F.lit("00"))) == 0)
    return kept.select("path", F.col("length").alias("size_bytes"), F.regexp_replace(body, "^﻿", "").alias("text"))


NOTEBOOK = "cells array<struct<cell_type:string,source:array<string>>>"


def read_notebooks(spark: SparkSession, root: str) -> DataFrame:
    """One row per notebook: (path, text, headings): markdown cells, comments of code cells, heading titles."""
    books = spark.read.schema(NOTEBOOK).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    cells = F.transform("cells", lambda c: F.struct(c["cell_type"].alias("kind"), F.array_join(c["source"], "").alias("body")))
    markdown = F.transform(F.filter(cells, lambda c: c["kind"] == "markdown"), lambda c: c["body"])
    code = F.transform(F.filter(cells, lambda c: c["kind"] == "code"), lambda c: c["body"])
    remarks = F.flatten(F.transform(code, lambda b: F.regexp_extract_all(b, F.lit(r"#\s*([^\n]+)"), F.lit(1))))
    titles = F.flatten(F.transform(markdown, lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))))
    return books.select(F.col("_metadata.file_path").alias("path"), F.array_join(F.concat(markdown, remarks), "\n").alias("text"), titles.alias("headings"))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of a database: rows (database, name, kind)."""
    found = [(t.database, t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(found, "database string, name string, kind string")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return reader.options(**options).load()
