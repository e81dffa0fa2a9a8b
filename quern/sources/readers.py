"""Readers and writers. Spark's readers do the work; files it can't parse are parsed on the driver, as they are small."""

from __future__ import annotations

import csv
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.audit import StepReport
from quern.config import CleanConfig
from quern.operators.impute import add_row_id
from quern.sources.netcdf import read_netcdf
from quern.sources.sniff import FileProfile, profile_source


class IngestionError(RuntimeError):
    pass


def null_variants(tokens: tuple[str, ...]) -> list[str]:
    """The tokens as they are, in lower case, in upper case and capitalised."""
    return list(dict.fromkeys(v for t in tokens for v in (t, t.lower(), t.upper(), t.capitalize())))


def blanked(c: Column, tokens: tuple[str, ...]) -> Column:
    return F.when(~c.isin(null_variants(tokens)), c)


def infer_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """bigint, double or boolean where every value of a text column reads as one; one aggregate."""
    if not columns:
        return {}
    aggs = [a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.count(F.col(c).try_cast("bigint")).alias(f"i{i}"), F.count(F.col(c).try_cast("double")).alias(f"d{i}"), F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}"), F.count_if(F.col(c).rlike(r"^\s*[-+]?[0-9]+\s*$")).alias(f"w{i}"))]
    row, out = df.agg(*aggs).first(), {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n and row[f"w{i}"] == n:
            out[c] = "bigint"
        elif n and row[f"d{i}"] == n:
            out[c] = "double"
        elif n and row[f"b{i}"] == n:
            out[c] = "boolean"
    return out


def _decoded(profile: FileProfile) -> str:
    return profile.path.read_bytes().decode(profile.encoding, errors="replace")


def read_csv(spark: SparkSession, profile: FileProfile, config: CleanConfig, report: StepReport) -> DataFrame:
    """Strict where every line has the header's width; else tolerant (all text, short lines filled with nulls,
    long ones cut), and without quoting where a quote is left open. Spark reads UTF-8 files itself; other encodings
    and files with a preamble are decoded on the driver."""
    sep = profile.separator or ","
    plain = profile.encoding in ("utf-8", "utf-8-sig", "latin-1") and not profile.skip_rows
    if plain:
        # in Spark: a file may be large; a quote is one byte in all three encodings
        quotes = spark.read.text(str(profile.path)).agg(F.sum(F.length("value") - F.length(F.translate("value", '"', "")))).first()[0]
        unbalanced = (quotes or 0) % 2 == 1
    else:
        text = _decoded(profile).lstrip("﻿")
        kept = [line for line in re.split(r"\r\n|\n|\r", text)][profile.skip_rows :]
        unbalanced = sum(line.count('"') for line in kept) % 2 == 1
    quote = "" if unbalanced else '"'
    with profile.path.open(encoding=profile.encoding, errors="replace", newline="") as f:
        for _ in range(profile.skip_rows):
            next(f, None)
        first = next(csv.reader(f, delimiter=sep, quoting=csv.QUOTE_NONE if unbalanced else csv.QUOTE_MINIMAL), [])
    names = [n.strip() or f"column_{i + 1}" for i, n in enumerate(first)] if profile.has_header else [f"column_{i + 1}" for i in range(len(first))]
    names = [n if names.index(n) == i else f"{n}_{i + 1}" for i, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(schema).option("sep", sep).option("header", profile.has_header).option("quote", quote).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).option("multiLine", not unbalanced and plain)
    if plain:
        df = reader.option("encoding", "ISO-8859-1" if profile.encoding == "latin-1" else "UTF-8").csv(str(profile.path))
    else:
        rows = [line for line in kept if line.strip()]
        df = reader.option("header", False).csv(spark.sparkContext.parallelize(rows[1:] if profile.has_header else rows, 1))
    df = df.cache()  # the corrupt-record column can't be queried alone from the file
    bad = df.where(F.col("_bad").isNotNull()).count()
    mode = "tolerant-unquoted" if unbalanced else "tolerant" if bad else "strict"
    report.measure("csv_mode", mode)
    report.measure("malformed_lines", bad)
    report.measure("dropped_lines", 0)
    if mode != "strict":
        report.warn(f"{bad} lines differ in width from the header ({mode})")
    df = df.drop("_bad").select(*(blanked(F.col(c), config.csv_null_values).alias(c) for c in names))
    if mode == "strict":
        types = infer_types(df, names)
        df = df.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in names))
    return df


def _cells(sheet: ET.Element, shared: list[str]) -> list[list]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    for row in sheet.iter(f"{ns}row"):
        line: list = []
        for c in row.iter(f"{ns}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            line += [None] * (at - 1 - len(line))
            v, kind = c.find(f"{ns}v"), c.get("t")
            inline = c.find(f"{ns}is")
            if inline is not None:
                line.append("".join(t.text or "" for t in inline.iter(f"{ns}t")))
            elif v is None:
                line.append(None)
            else:
                line.append(shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text))
        out.append(line)
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | None, report: StepReport) -> DataFrame:
    """One sheet of an .xlsx file (zipped XML); the first, unless named."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): rels[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")] for s in book.iterfind("m:sheets/m:sheet", ns)}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(sheets)}")
        if sheet is None and len(sheets) > 1:
            report.warn(f"{len(sheets)} sheets; the first is read")
        target = sheets[sheet or next(iter(sheets))].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = _cells(ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")), shared)
    return _frame(spark, rows)


def _frame(spark: SparkSession, rows: list[list]) -> DataFrame:
    """A table from a header row and value rows; numbers that are all whole become bigint."""
    if not rows:
        raise IngestionError("no rows")
    names, body = [str(n) for n in rows[0]], [r + [None] * (len(rows[0]) - len(r)) for r in rows[1:]]
    fields, columns = [], []
    for i, n in enumerate(names):
        values = [r[i] for r in body]
        some = [v for v in values if v is not None]
        if some and all(isinstance(v, float) for v in some):
            whole = all(v.is_integer() for v in some)
            fields.append(T.StructField(n, T.LongType() if whole else T.DoubleType()))
            columns.append([None if v is None else int(v) if whole else v for v in values])
        else:
            fields.append(T.StructField(n, T.StringType()))
            columns.append([None if v is None else str(v) for v in values])
    return spark.createDataFrame(list(zip(*columns)) if columns else [], T.StructType(fields))


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """The first binary table of a FITS file; columns of one value a row."""
    import numpy as np

    kinds = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
    raw, at = Path(path).read_bytes(), 0
    while at < len(raw):
        header: dict[str, str] = {}
        end = False
        while not end:
            for card in (raw[at + i * 80 : at + i * 80 + 80].decode("ascii", "replace") for i in range(36)):
                if card.startswith("END "):
                    end = True
                    break
                if card[8:10] == "= ":
                    header[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
            at += 2880
        naxis = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header.get("NAXIS", 0)))]
        size = abs(int(header.get("BITPIX", 8))) // 8 * int(np.prod(naxis)) if naxis else 0
        if header.get("XTENSION") == "BINTABLE":
            fields, plain = [], []
            for i in range(1, int(header["TFIELDS"]) + 1):
                n, kind = re.match(r"(\d*)([A-Z])", header[f"TFORM{i}"]).groups()
                n = int(n or 1)
                name = header.get(f"TTYPE{i}", f"column_{i}")
                fields.append((name, f"S{n}") if kind == "A" else (name, kinds[kind]) if n == 1 else (name, kinds[kind], (n,)))
                if kind == "A" or n == 1:
                    plain.append(name)
            table = np.frombuffer(raw[at : at + naxis[0] * naxis[1]], np.dtype(fields))
            rows = zip(*([v.decode("utf-8", "replace").strip() for v in table[n].tolist()] if table[n].dtype.kind == "S" else table[n].tolist() for n in plain))
            return spark.createDataFrame(list(rows), plain)
        at += -(-(size + int(header.get("PCOUNT", 0))) // 2880) * 2880
    raise IngestionError("no binary table")


def read_sql(spark: SparkSession, source: str, query: str | None = None, table: str | None = None, report: StepReport | None = None) -> DataFrame:
    """A query over the session's views (`:memory:`), or over a DuckDB file where the duckdb package is there."""
    report = report or StepReport("ingest")
    if source == ":memory:" or not source:
        views = [t.name for t in spark.catalog.listTables()]
        if query:
            return spark.sql(query)
        if not (table or views):
            raise ValueError("no tables")
        if not table and len(views) > 1:
            report.warn(f"{len(views)} tables; {views[0]} is read")
        return spark.table(table or views[0])
    try:
        import duckdb
    except ImportError as e:
        raise IngestionError("reading DuckDB files needs the duckdb package") from e
    with duckdb.connect(source, read_only=True) as con:
        names = [r[0] for r in con.execute("SHOW TABLES").fetchall()]
        if not (query or table or names):
            raise ValueError("no tables")
        if not (query or table) and len(names) > 1:
            report.warn(f"{len(names)} tables; {names[0]} is read")
        return spark.createDataFrame(con.execute(query or f'SELECT * FROM "{table or names[0]}"').to_arrow_table())


def read_any(spark: SparkSession, source: str, config: CleanConfig | None = None, query: str | None = None, table: str | None = None) -> tuple[DataFrame, StepReport]:
    """Any source as a table with a stable row order."""
    config, report = config or CleanConfig(), StepReport("ingest")
    source = str(source)
    suffix = os.path.splitext(source.rstrip("/"))[1].lower()
    if source == ":memory:" or (query and not suffix):
        return add_row_id(read_sql(spark, source, query, table, report)), report
    if "://" in source or os.path.isdir(source) or any(c in source for c in "*?["):
        fmt = {".csv": "csv", ".tsv": "csv", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc"}.get(suffix, "parquet")
        reader = spark.read.option("mergeSchema", True)
        df = reader.format(fmt).load(source) if fmt != "csv" else reader.option("header", True).option("inferSchema", True).csv(source)
    else:
        profile = profile_source(source)
        report.measure("format", profile.fmt)
        report.measure("encoding", profile.encoding)
        if profile.fmt == "csv":
            df = read_csv(spark, profile, config, report)
        elif profile.fmt == "parquet":
            df = spark.read.parquet(source)
        elif profile.fmt in ("json", "ndjson"):
            df = spark.read.option("multiLine", profile.fmt == "json").json(source)
        elif profile.fmt == "orc":
            df = spark.read.orc(source)
        elif profile.fmt == "excel":
            df = read_excel(spark, source, config.excel_sheet, report)
        elif profile.fmt == "fits":
            df = read_fits(spark, source)
        elif profile.fmt == "netcdf":
            df = read_netcdf(spark, source)
        elif profile.fmt == "duckdb":
            df = read_sql(spark, source, query, table, report)
        else:
            raise IngestionError(f"{profile.fmt} files can't be read here")
    df = add_row_id(df)
    report.act(f"read {source}")
    report.measure("columns", len(df.columns) - 1)
    return df, report


def write_output(df: DataFrame, path: str, single: bool = False) -> str:
    """CSV, TSV, newline-delimited JSON, ORC or Parquet (zstd) by suffix; a folder of part files unless single."""
    out = df.drop("_row_id")
    out = out.coalesce(1) if single else out
    suffix = os.path.splitext(path)[1].lower()
    w = out.write.mode("overwrite")
    if suffix in (".csv", ".tsv"):
        w.option("header", True).option("sep", "\t" if suffix == ".tsv" else ",").csv(path)
    elif suffix in (".json", ".ndjson", ".jsonl"):
        w.json(path)
    elif suffix == ".orc":
        w.orc(path)
    elif suffix in (".arrow", ".ipc", ".feather"):
        import pyarrow as pa

        table = out.toArrow()
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as writer:
            writer.write_table(table)
    else:
        w.option("compression", "zstd").parquet(path)
    return path
