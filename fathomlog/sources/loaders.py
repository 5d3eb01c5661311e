"""CSV, JSON, JSON lines, Parquet and Mermaid files; JSON, CSV and spreadsheets over HTTP.

All but Mermaid and HTTP are read by Spark in parallel. A cell that its declared type does
not admit fails the load, with the column in the message, rather than becoming null.
"""

from __future__ import annotations

import csv as csv_module
import io
import re
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomlog.functions import values as V
from fathomlog.plans.typing import declared, spark_type
from fathomlog.storage import new_root
from fathomlog.syntax import MAX_INT, Column, Input, ProgramError, TypeRef

INTEGER = r"^(0|-?[1-9][0-9]*)$"
FLOAT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def _must(ok: SparkColumn, value: SparkColumn, message: str, shown: SparkColumn | None = None) -> SparkColumn:
    text = F.lit(message) if shown is None else F.concat(F.lit(message + ": "), F.coalesce(shown.cast("string"), F.lit("null")))
    return F.when(ok, value).otherwise(F.raise_error(text))


def cell(text: SparkColumn, c: Column, name: str) -> SparkColumn:
    """A text cell in a declared type: trimmed but for strings; empty is null only where null is allowed."""
    t = declared(c.type)
    if t.base == "string":
        return F.coalesce(text, F.lit(""))
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    where = f"{name}.{c.name}: not a {t.base}"
    if t.base == "integer":
        n = F.when(trimmed.rlike(INTEGER), trimmed.try_cast("long"))
        value = _must(n.between(-MAX_INT, MAX_INT), n, where, text)
    elif t.base == "float":
        x = F.when(trimmed.rlike(FLOAT), trimmed.try_cast("double"))
        value = _must(F.abs(x) < F.lit(float("inf")), x, where, text)
    elif t.base == "boolean":
        low = F.lower(trimmed)
        value = F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
        value = _must(value.isNotNull(), value, where, text)
    else:
        v = contract(V.parse(trimmed), c, name)
        value = _must(v.isNotNull(), v, where, text)
    null = F.lit("null") if t.base == "value" else F.lit(None).cast(spark_type(t.base))
    return F.when(trimmed == "", null).otherwise(value) if t.nullable else value


def fits(x, ref: TypeRef, path: str = "$") -> str | None:
    """Where parsed JSON breaks a structural contract, or None."""
    if x is None:
        return None if ref.nullable or ref.base == "null" else f"{path} is null"
    base = ref.base
    if isinstance(base, dict):
        if "array" in base:
            if not isinstance(x, list):
                return f"{path} is no array"
            return next((bad for k, y in enumerate(x) if (bad := fits(y, base["array"], f"{path}[{k}]"))), None)
        if not isinstance(x, dict):
            return f"{path} is no object"
        fields = {n: (o, t) for n, o, t in base["record"]}
        for n, (optional, _) in fields.items():
            if n not in x and not optional:
                return f"{path}.{n} is missing"
        for n, y in x.items():
            if n not in fields:
                return f"{path}.{n} is not declared"
            if bad := fits(y, fields[n][1], f"{path}.{n}"):
                return bad
        return None
    if isinstance(x, dict) and "$proof" in x and base != "value":
        return f"{path} is a proof"
    ok = {"value": lambda: True, "string": lambda: isinstance(x, str), "boolean": lambda: isinstance(x, bool), "null": lambda: False, "float": lambda: not isinstance(x, bool) and isinstance(x, int | float), "integer": lambda: not isinstance(x, bool) and isinstance(x, int)}[base]()
    return None if ok else f"{path} is no {base}"


def contract(text: SparkColumn, c: Column, name: str) -> SparkColumn:
    """Canonical text checked against the declared shape; a bare null only where allowed."""
    ref = c.type
    if not isinstance(ref.base, dict):
        return text if ref.nullable else _must(text.isNull() | (text != "null"), text, f"{name}.{c.name}: null")
    problem = V._udf("string", lambda t: fits(V.load(t), ref) or "")(text)
    return _must(text.isNull() | (problem == ""), text, f"{name}.{c.name}", problem)


def csv(spark: SparkSession, path: str, decl: Input, header: bool = True) -> DataFrame:
    # A record that goes on in the next line leaves a line with an odd number of quotes; files without are read in splits.
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    folded = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    reader = spark.read.options(header=str(header).lower(), multiLine=str(folded).lower(), escape='"', charToEscapeQuoteEscaping='"', mode="FAILFAST", enforceSchema="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", inferSchema="false")
    raw = reader.csv(path)
    if header:
        names = [n.lstrip("﻿") for n in raw.columns]
        raw = raw.toDF(*names)
        for c in decl.columns:
            if names.count(c.name) != 1:
                raise ProgramError(f"{path}: column {c.name} stands {names.count(c.name)} times in the header")
        picked = [cell(F.col(f"`{c.name}`"), c, decl.name).alias(f"c{k}") for k, c in enumerate(decl.columns)]
    else:
        if len(raw.columns) != len(decl.columns):
            raise ProgramError(f"{path}: {len(raw.columns)} columns for {len(decl.columns)} declared")
        picked = [cell(F.col(f"`{n}`"), c, decl.name).alias(f"c{k}") for k, (n, c) in enumerate(zip(raw.columns, decl.columns, strict=True))]
    return raw.select(*picked)


def _typed_json(text: SparkColumn, c: Column, name: str) -> SparkColumn:
    """A canonical JSON cell in its declared type, checked, not coerced; missing cells are errors."""
    t = declared(c.type)
    where = f"{name}.{c.name}: not a {t}"
    if t.base == "value":
        v = contract(text, c, name)
        return _must(v.isNotNull(), v, f"{name}.{c.name}: missing")
    get = {"string": V.as_string, "integer": V.as_integer, "float": V.as_float, "boolean": V.as_boolean}.get(t.base)
    null = F.lit(None).cast(spark_type(t.base))
    value = null if get is None else get(text)
    ok = value.isNotNull()
    if t.nullable:
        return F.when(text == "null", null).otherwise(_must(ok, value, where, text))
    return _must(ok, value, where, text)


def jsonl(spark: SparkSession, path: str, decl: Input) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    only = decl.columns[0]
    if len(decl.columns) == 1 and declared(only.type).base == "value":
        parsed = V.parse(F.col("line"))
        return lines.select(contract(_must(parsed.isNotNull(), parsed, f"{decl.name}: malformed line", F.col("line")), only, decl.name).alias("c0"))
    # One step parses the line; a generator keeps it from being done again for each column.
    cells = lines.select("line", F.explode(F.array(V.row([c.name for c in decl.columns])(F.col("line")))).alias("cells"))
    whole = _must(F.col("cells").isNotNull(), F.col("cells"), f"{decl.name}: malformed line", F.col("line"))
    return cells.select(*(_typed_json(whole[k], c, decl.name).alias(f"c{k}") for k, c in enumerate(decl.columns)))


def document(spark: SparkSession, texts: DataFrame, decl: Input) -> DataFrame:
    """Whole documents, one row each, for an input with one value column."""
    if len(decl.columns) != 1 or declared(decl.columns[0].type).base != "value":
        raise ProgramError(f"{decl.name}: a JSON document needs one column of type value")
    parsed = V.parse(F.regexp_replace("value", "^﻿", ""))
    return texts.select(contract(_must(parsed.isNotNull(), parsed, f"{decl.name}: malformed document"), decl.columns[0], decl.name).alias("c0"))


def json_file(spark: SparkSession, path: str, decl: Input) -> DataFrame:
    return document(spark, spark.read.text(path, wholetext=True), decl)


def fetch(url: str) -> str:
    """Text of a page; http and https only."""
    if not re.match(r"https?://", url):
        raise ProgramError(f"{url}: only http and https")
    with urllib.request.urlopen(url, timeout=60) as f:
        return f.read().decode()


def json_url(spark: SparkSession, url: str, decl: Input) -> DataFrame:
    return document(spark, spark.createDataFrame([(fetch(url),)], "value string"), decl)


def csv_url(spark: SparkSession, url: str, decl: Input) -> DataFrame:
    """A CSV page with a header, read by the driver; rows of another width than it are errors."""
    rows = [r for r in csv_module.reader(io.StringIO(fetch(url).lstrip("\ufeff"))) if r]
    names = rows[0] if rows else []
    for c in decl.columns:
        if names.count(c.name) != 1:
            raise ProgramError(f"{url}: column {c.name} stands {names.count(c.name)} times in the header")
    for k, r in enumerate(rows):
        if len(r) != len(names):
            raise ProgramError(f"{url}: line {k + 1} has {len(r)} cells, not {len(names)}")
    at = [names.index(c.name) for c in decl.columns]
    raw = spark.createDataFrame([[r[k] for k in at] for r in rows[1:]], ", ".join(f"x{k} string" for k in range(len(at))))
    return raw.select(*(cell(F.col(f"x{k}"), c, decl.name).alias(f"c{k}") for k, c in enumerate(decl.columns)))


def sheet(spark: SparkSession, url: str, decl: Input) -> DataFrame:
    """A shared spreadsheet by its address (its ``gid`` names the sheet), through its CSV export."""
    found = re.match(r"(https://docs\.google\.com/spreadsheets/d/[^/]+)(?:.*?[#&?]gid=([0-9]+))?", url)
    if not found:
        raise ProgramError(f"{url} is no spreadsheet")
    return csv_url(spark, f"{found[1]}/export?format=csv&gid={found[2] or 0}", decl)


def from_frame(df: DataFrame, decl: Input) -> DataFrame:
    """Declared columns of a DataFrame or Parquet file, by exact name, in the declared types."""
    by_name = {f.name: f for f in df.schema.fields}
    out = []
    for k, c in enumerate(decl.columns):
        if c.name not in by_name:
            raise ProgramError(f"{decl.name}: there is no column {c.name}")
        out.append(_column(F.col(f"`{c.name}`"), by_name[c.name].dataType, c, decl.name).alias(f"c{k}"))
    return df.select(*out)


def _column(col: SparkColumn, kind: T.DataType, c: Column, name: str) -> SparkColumn:
    t = declared(c.type)
    where = f"{name}.{c.name}"
    whole = isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    if isinstance(kind, T.BinaryType):
        raise ProgramError(f"{where}: raw bytes")
    if t.base == "value":
        if isinstance(kind, T.StringType):
            out = V.quote(col)
        elif whole:
            out = col.cast("string")
        elif isinstance(kind, T.BooleanType | T.DoubleType | T.FloatType):
            out = V.lift(col.cast("double"), "float") if not isinstance(kind, T.BooleanType) else V.lift(col, "boolean")
        else:
            out = V.parse(F.to_json(col, {"ignoreNullFields": "false"}))
        return contract(F.coalesce(out, F.lit("null")) if c.type.nullable else _must(out.isNotNull(), out, f"{where}: null"), c, name)
    if t.base == "string":
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            out = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif isinstance(kind, T.DateType):
            out = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, T.StringType):
            out = col
        else:
            raise ProgramError(f"{where}: {kind.simpleString()} is no string")
    elif t.base == "integer":
        if not whole:
            raise ProgramError(f"{where}: {kind.simpleString()} is no integer")
        out = col.cast("long")
        if isinstance(kind, T.LongType):
            out = F.when(out.isNull(), out).otherwise(_must(out.between(-MAX_INT, MAX_INT), out, f"{where}: out of range", col))
    elif t.base == "float":
        if not (whole or isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType)):
            raise ProgramError(f"{where}: {kind.simpleString()} is no float")
        out = col.cast("double")
    elif t.base == "boolean":
        if not isinstance(kind, T.BooleanType):
            raise ProgramError(f"{where}: {kind.simpleString()} is no boolean")
        out = col
    else:
        out = F.lit(None).cast("string")
    return out if t.nullable else _must(out.isNotNull(), out, f"{where}: null")


def parquet(spark: SparkSession, path: str, decl: Input) -> DataFrame:
    return from_frame(spark.read.parquet(path), decl)


_NODE = r"([A-Za-z0-9_]+)\s*(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\})?"
_ARROW = r"\s*(?:--\s+([^-|>]+?)\s+-->|-->\s*\|([^|]*)\||[-=.]+>|---)\s*"


def mermaid_edges(text: str) -> list[tuple[str, str, str]]:
    """(from, to, label) of each edge of a flowchart; chains give several; lines with & none."""
    out = []
    for line in text.lstrip("﻿").splitlines():
        line = line.split("%%")[0].strip().rstrip(";")
        if not line or "&" in line or re.match(r"(graph|flowchart|subgraph|end\b|style|classDef|class|click|linkStyle|direction)", line):
            continue
        at = re.match(_NODE, line)
        while at:
            arrow = re.compile(_ARROW).match(line, at.end())
            target = arrow and re.compile(_NODE).match(line, arrow.end())
            if not target:
                break
            out.append((at[1], target[1], (arrow[1] or arrow[2] or "").strip().strip('"')))
            at = target
    return out


def mermaid(spark: SparkSession, path: str, decl: Input) -> DataFrame:
    n = len(decl.columns)
    if n not in (2, 3) or any(declared(c.type).base != "string" for c in decl.columns):
        raise ProgramError(f"{decl.name}: a diagram gives two or three string columns")
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame([e[:n] for e in mermaid_edges(text)], ", ".join(f"c{k} string" for k in range(n)))


Loader = Callable[[SparkSession, str, Input], DataFrame]
#: Loaders by format; formats are file extensions.
LOADERS: dict[str, Loader] = {"csv": csv, "jsonl": jsonl, "ndjson": jsonl, "json": json_file, "parquet": parquet, "mmd": mermaid, "mermaid": mermaid}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads the path from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fetched(spark: SparkSession, url: str, kind: str) -> str:
    """A page put into the folder that executors share, as a file."""
    path = f"{new_root(spark, 'fetched')}/page.{kind}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    with urllib.request.urlopen(url, timeout=60) as page:
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        while part := page.read(1 << 20):
            stream.write(bytearray(part))
        stream.close()
    return path


def load(spark: SparkSession, path: str, decl: Input, fmt: str | None = None, header: bool = True) -> DataFrame:
    """By the format named, else the extension; ``gh:owner/repo/path`` is a file of a public host.

    ``header`` says whether the first row of CSV files names the columns.
    """
    if path.startswith("gh:"):
        owner, repo, rest = path[3:].split("/", 2)
        path = f"https://raw.githubusercontent.com/{owner}/{repo}/HEAD/{rest}"
    kind = fmt or path.split("?")[0].rsplit(".", 1)[-1].lower()
    if re.match(r"https?://", path):
        if "docs.google.com/spreadsheets" in path or fmt == "gsheet":
            return sheet(spark, path, decl)
        if kind == "json":
            return json_url(spark, path, decl)
        if kind == "csv" and header:
            return csv_url(spark, path, decl)
        if kind in LOADERS:
            path = fetched(spark, path, kind)
    if kind not in LOADERS:
        raise ProgramError(f"{path}: unknown format {kind}; known are {', '.join(LOADERS)}")
    return csv(spark, path, decl, header) if kind == "csv" else LOADERS[kind](spark, path, decl)
