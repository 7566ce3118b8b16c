"""CSV files: encoding and separator detection, typed reading, load facts."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import fixed
from ..functions.predicates import strip
from ..operators.cells import cells_of
from ..operators.samples import RowOrder
from .facts import facts_of
from .table import SourceTable

_CORRUPT = "_corrupt_record"
_READ_STEP = 64 << 10


# --- detection --------------------------------------------------------------


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, length, modified)`` of the files; contents are not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"no such file: {path}") from exc
        raise


def read_heads(files: DataFrame, skiprows: int = 0) -> DataFrame:
    """``(path, length, head)``: the first bytes of each file, enough for the
    sniffed lines after ``skiprows`` others and never less than the sniffed bytes. One task reads the
    heads of its files; no file is read whole unless its first lines fill it."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                url = path if "://" in path else path.replace("file:/", "file:///", 1)
                fs, inner = pafs.FileSystem.from_uri(url)
                with fs.open_input_stream(inner) as stream:
                    head = stream.read(_READ_STEP)
                    while head.count(b"\n") < skiprows + fixed.CSV_SNIFF_LINES:
                        more = stream.read(_READ_STEP)
                        if not more:
                            break
                        head += more
                out.append(head)
            yield pdf[["path", "length"]].assign(head=out)

    return files.select("path", "length").mapInPandas(heads, "path string, length bigint, head binary")


def detect_encoding(heads: DataFrame) -> DataFrame:
    """Add ``encoding``: utf-8 when the first bytes are valid UTF-8, else
    latin-1 (which accepts every byte). A character cut by the edge of the
    window does not count against UTF-8."""
    window = F.substring("head", 1, fixed.CSV_SNIFF_BYTES)
    cut = F.when(F.length("head") > fixed.CSV_SNIFF_BYTES, 3).otherwise(0)
    valid = F.lit(False)
    for drop in range(4):
        shorter = F.substring(window, F.lit(1), F.length(window) - drop)
        valid = valid | ((cut >= drop) & F.is_valid_utf8(shorter.cast("string")))
    return heads.withColumn("encoding", F.when(valid, F.lit("utf-8")).otherwise(F.lit("latin-1")))


def head_lines(heads: DataFrame, skiprows: int = 0) -> DataFrame:
    """``(path, line)``: the sniffed lines of each file."""
    text = F.when(F.col("encoding") == "utf-8", F.col("head").cast("string")).otherwise(
        F.decode("head", "iso-8859-1")
    )
    lines = F.slice(F.split(text, "\r\n|\n|\r"), 1 + skiprows, fixed.CSV_SNIFF_LINES)
    return heads.select("path", F.explode(lines).alias("line"))


def separator_votes(lines: DataFrame, key: str = "path") -> DataFrame:
    """``(key, separator)`` from ``(key, line)``: the separator whose most
    frequent number per line, plus one, times the number of lines that have it,
    is the greatest. Ties go to the smaller number, then to the separator that
    is listed first; ',' when none occurs."""
    seps = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("sep")) for i, s in enumerate(fixed.CSV_SEPARATORS)])
    counted = (
        lines.where(strip(F.col("line")) != "")
        .select(key, "line", F.inline(seps))
        .select(
            key,
            "at",
            "sep",
            (F.length("line") - F.length(F.replace("line", F.col("sep"), F.lit("")))).alias("n"),
        )
        .groupBy(key, "at", "sep", "n")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    # Most lines first, then the smaller count: the greatest of (lines, -n).
    modes = counted.groupBy(key, "at", "sep").agg(F.max(F.struct("lines", -F.col("n"))).alias("m"))
    scored = modes.select(
        key,
        F.when(F.col("m.col2") < 0, (1 - F.col("m.col2")) * F.col("m.lines")).alias("score"),
        (-F.col("at")).alias("before"),
        "sep",
    )
    best = scored.groupBy(key).agg(
        F.max(F.when(F.col("score").isNotNull(), F.struct("score", "before", "sep"))).alias("best")
    )
    return (
        lines.select(key).distinct().join(best, key, "left")
        .select(key, F.coalesce("best.sep", F.lit(fixed.CSV_SEPARATORS[0])).alias("separator"))
    )


def header_of(head: str, separator: str, quote: str, skiprows: int) -> tuple[list[str], int]:
    """(names, before): the cells of the first line that is not blank after
    ``skiprows`` lines, and how many lines before it are not blank."""
    lines = re.split("\r\n|\n|\r", head.removeprefix("\ufeff"))
    before = sum(bool(line.strip()) for line in lines[:skiprows])
    rest = [line for line in lines[skiprows:] if line.strip()]
    quoting = csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE
    return next(csv.reader(rest, delimiter=separator, quotechar=quote or None, quoting=quoting), []), before


def sniff(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = None,
    *,
    sep: str | None = None,
    encoding: str | None = None,
    quote: str = '"',
    skiprows: int = 0,
) -> DataFrame:
    """``(path, length, encoding, separator, header, before)`` for every file;
    encoding and separator are detected unless given. ``header`` has the column
    names after ``skiprows`` lines, ``before`` says how many of these are not
    blank."""
    heads = detect_encoding(read_heads(list_files(spark, path, glob), skiprows))
    if encoding is not None:
        heads = heads.withColumn("encoding", F.lit(encoding))
    separator = F.coalesce("separator", F.lit(fixed.CSV_SEPARATORS[0])) if sep is None else F.lit(sep)
    files = heads.join(separator_votes(head_lines(heads, skiprows)), "path", "left").withColumn("separator", separator)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [h.decode(e, "replace") for h, e in zip(pdf["head"], pdf["encoding"])]
            found = [header_of(t, s, quote, skiprows) for t, s in zip(texts, pdf["separator"])]
            yield pdf.drop(columns="head").assign(header=[h for h, _ in found], before=[b for _, b in found])

    columns = ["path", "length", "encoding", "separator"]
    schema = "path string, length bigint, encoding string, separator string, header array<string>, before int"
    return files.select(*columns, "head").mapInPandas(headers, schema)


# --- typing -----------------------------------------------------------------

_INT = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)\s*$"
_BOOL = ["True", "TRUE", "true", "False", "FALSE", "false"]


def without_na(c: Column) -> Column:
    return F.when(~c.isin(fixed.CSV_NA_TOKENS), c)


def column_kinds(df: DataFrame) -> DataFrame:
    """``(col_pos, name, kind)`` of text columns by all their values: one scan.
    A column of nothing but missing cells is float64."""
    return _measure(df).select("col_pos", "name", "kind")


def _measure(df: DataFrame) -> DataFrame:
    """The same with the number of values, of rows and of misshaped rows."""
    cells = [c for c in cells_of(df) if c.name != _CORRUPT]
    sums = []
    for c in cells:
        v = without_na(c.raw)
        is_int = v.rlike(_INT) & (v.isNull() | F.trim(v).try_cast("bigint").isNotNull())
        sums += [
            F.count(v).alias(f"n{c.pos}"),
            F.bool_and(is_int).alias(f"i{c.pos}"),
            F.bool_and(v.rlike(_FLOAT)).alias(f"f{c.pos}"),
            F.bool_and(v.isin(_BOOL)).alias(f"b{c.pos}"),
        ]
    corrupt = F.count(_CORRUPT) if _CORRUPT in df.columns else F.lit(0).cast("bigint")
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), corrupt.alias("n_corrupt"), *sums)

    def kind(c) -> Column:
        n = F.col(f"n{c.pos}")
        whole = n == F.col("n_rows")
        return (
            F.when(n == 0, "float64")
            .when(F.col(f"i{c.pos}"), F.when(whole, "int64").otherwise("Int64"))
            .when(F.col(f"f{c.pos}"), "float64")
            .when(F.col(f"b{c.pos}"), F.when(whole, "bool").otherwise("boolean"))
            .otherwise("object")
        )

    rows = [
        F.struct(
            F.lit(c.pos).alias("col_pos"),
            F.lit(c.name).alias("name"),
            kind(c).alias("kind"),
            F.col(f"n{c.pos}").alias("present"),
        )
        for c in cells
    ]
    return wide.select("n_rows", "n_corrupt", F.inline(F.array(*rows)))


def apply_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast text columns to the kinds found; missing cells become null."""
    spark_types = {"int64": "bigint", "Int64": "bigint", "float64": "double", "bool": "boolean", "boolean": "boolean"}

    def cast(c) -> Column:
        v = without_na(c.raw)
        to = spark_types.get(kinds[c.name])
        return (F.trim(v).try_cast(to) if to else v).alias(c.name)

    return df.select(*[cast(c) for c in cells_of(df)])


# --- reading ----------------------------------------------------------------


def _needs_whole_files(spark: SparkSession, paths: list[str], quote: str) -> bool:
    """Whether cells may run over line ends, so that files cannot be split:
    whether some line has an odd number of quotes. All lines of files of any
    size decide, so that the rows do not depend on how files are split."""
    if not quote:
        return False
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return bool(spark.read.text(paths).where(quotes % 2 == 1).take(1))


def _own_names(header: list[str]) -> list[str]:
    """Column names of a header: a blank one is told by its place, a repeated
    one gets its place as well."""
    names = [n if n.strip() else f"_c{i}" for i, n in enumerate(header)]
    low = [n.lower() for n in names]
    return [n if low.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(names)]


def _without_first(rows: DataFrame, n: int) -> DataFrame:
    """Rows of CSV files without the first ``n`` of each file. The part of a
    file that begins it is read by one task, in order; the others hold none of
    its first rows, unless these fill that part."""
    columns = rows.columns
    begins = F.col("_metadata.file_block_start") == 0
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), begins.alias("_begins"), F.monotonically_increasing_id().alias("_at"))
    # One row per file.
    first = placed.where("_begins").groupBy("_file").agg(F.min("_at").alias("_first"))
    kept = placed.join(F.broadcast(first), "_file", "left").where(~F.col("_begins") | (F.col("_at") >= F.col("_first") + n))
    return kept.select(*columns)


def load_csv(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str | None = None,
    encoding: str | None = None,
    nrows: int | None = None,
    skiprows: int = 0,
    glob: str | None = None,
    options: dict[str, str] | None = None,
) -> SourceTable:
    """Read one or many CSV files of one table.

    Encoding and separator are detected per file unless given. Every file is
    read by its own header, the first line that is not blank after ``skiprows``
    lines; files that agree in all that are read together, and the parts are
    joined by column name. A column that a file lacks is missing in its rows,
    and a warning (``column_sets``) tells how many sets of columns there are.
    Cells are typed by all their values, never by a sample; dates stay text. A
    file is split between tasks unless a quoted cell of some file runs over a
    line end. ``options`` go to Spark's reader.
    """
    quote = (options or {}).get("quote", '"')
    # One row per file, as in Spark's own file listing.
    found = sniff(spark, path, glob, sep=sep, encoding=encoding, quote=quote, skiprows=skiprows).collect()
    groups: dict[tuple, list] = {}
    for f in found:
        groups.setdefault((f["encoding"], f["separator"], tuple(f["header"]), f["before"]), []).append(f["path"])

    parts = []
    whole = _needs_whole_files(spark, [f["path"] for f in found], quote)
    for (enc, separator, header, before), paths in sorted(groups.items()):
        fixed_options = {
            "header": str(not skiprows).lower(),
            "sep": separator,
            "encoding": {"latin-1": "iso-8859-1"}.get(enc, enc),
            "quote": '"',
            "escape": '"',
            "multiLine": str(whole).lower(),
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": _CORRUPT,
            **(options or {}),
        }
        paths = sorted(paths)
        names = _own_names(list(header)) if skiprows else spark.read.options(**fixed_options).csv(paths[0]).columns
        schema = T.StructType([T.StructField(n.lstrip("\ufeff"), T.StringType()) for n in names])
        rows = spark.read.options(**fixed_options).schema(schema.add(_CORRUPT, T.StringType())).csv(paths)
        parts.append(_without_first(rows, before + 1) if skiprows else rows)
    raw = parts[0] if len(parts) == 1 else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if nrows is not None:
        order = RowOrder(raw, None)
        raw = order.first(order.keyed(raw, F.struct(*raw.columns).alias("row")), nrows).select("row.*")
    measured = _measure(raw).collect()  # one row per column
    kinds = {r["name"]: r["kind"] for r in measured}
    df = apply_kinds(raw.drop(_CORRUPT), kinds)
    info = facts_of(measured[0]["n_rows"], {r["name"]: r["present"] for r in measured})
    if measured[0]["n_corrupt"]:
        info["warnings"].append(f"misshaped_rows={measured[0]['n_corrupt']}")
    sets = {frozenset(f["header"]) for f in found}
    if len(sets) > 1:
        info["warnings"].append(f"column_sets={len(sets)}")
    first = min(found, key=lambda f: f["path"])
    info.update(
        encoding=first["encoding"],
        encoding_auto_detected=encoding is None,
        separator=first["separator"],
        separator_auto_detected=sep is None,
        kinds=kinds,
        file_size_kb=round(sum(f["length"] for f in found) / 1024, 1),
    )
    shown = path if isinstance(path, str) else path[0]
    return SourceTable(df, "csv", shown, info)
