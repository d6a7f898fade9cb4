"""File and in-memory sources (SRC-01..SRC-04, SRC-06)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.timeops import strict_timestamp
from wattline.sources.schemas import PAYLOAD_RECORD


def missing_nan(df: DataFrame) -> DataFrame:
    """S9 on ingest: NaN in a float or double column is a missing value."""
    kinds = (T.FloatType, T.DoubleType)
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             mode: str = "PERMISSIVE") -> DataFrame:
    """SRC-01: CSV with a header row; empty fields, ``NA`` and NaN are missing (S9).

    Without ``schema`` the types are inferred from every row, which costs one
    extra pass over the files; pass the schema at scale.
    ``mode="FAILFAST"`` fails on a malformed line instead of nulling it.
    """
    r = spark.read.option("header", True).option("mode", mode).option("nullValue", "NA")
    return missing_nan((r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path))


def read_series_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    time_col: str = "time") -> DataFrame:
    """SRC-02: CSV scan; a ``time`` column, if any, becomes a naive timestamp.

    Strict throughout: a malformed line or a time text that is not a
    timestamp fails the job instead of turning into NULLs.
    """
    df = read_csv(spark, path, schema, mode="FAILFAST")
    if time_col not in df.columns:
        return df
    kind = df.schema[time_col].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    return df.withColumn(time_col, strict_timestamp(F.col(f"`{time_col}`")))


def _landed_records(doc: Column, record: T.StructType) -> Column:
    """Records of one landed document, by its shape; fails on a shape it does not know."""
    listed = f"array<{record.simpleString()}>"
    shape = F.schema_of_variant(doc)
    data = F.try_variant_get(doc, "$.data", "variant")
    kind = F.when(data.isNull(), "").otherwise(F.schema_of_variant(data))
    lists = "^ARRAY<(OBJECT<.*>|VOID)>$"
    none = F.array().cast(listed)
    return (F.when(shape.rlike(lists), F.variant_get(doc, "$", listed))
            .when(shape.startswith("OBJECT") & kind.rlike(lists), F.variant_get(doc, "$.data", listed))
            .when(shape.startswith("OBJECT") & kind.isin("", "VOID")
                  & F.try_variant_get(doc, "$.attributes", "variant").isNull(), none)
            .otherwise(F.raise_error(F.concat(F.lit("not a landed response: "), F.substring(shape, 1, 200)))))


def read_landed_payloads(spark: SparkSession, path: str,
                         record: T.StructType = PAYLOAD_RECORD, multi_line: bool = True) -> DataFrame:
    """SRC-03: landed API responses (JSON), one row per record.

    A document is a response envelope with a ``data`` list, or a bare list of
    records (with ``multi_line``); its shape tells.  An envelope without
    ``data`` yields no rows.  Anything else (a scalar, a ``data`` that is no
    list, a bare record) and malformed text fail the job rather than vanish.
    The declared record type turns integer quantities into doubles.
    ``multi_line`` reads one (indented) document per file, as a response is
    saved; turn it off for JSON lines, which split into parallel tasks within
    a file.
    """
    docs = (spark.read.option("singleVariantColumn", "doc").option("multiLine", multi_line)
            .option("mode", "FAILFAST").json(path))
    return docs.select(F.explode(_landed_records(F.col("doc"), record)).alias("rec")).select("rec.*")

# How much of each end of a dump the driver looks at.
DUMP_HEAD, DUMP_TAIL = 65_536, 4_096
_OPENING = r'^\s*(?:\{\s*"data"\s*:\s*)?\['
_CLOSING = r"\]\s*\}?\s*$"


def dump_separator(head: str, tail: str) -> str:
    """The text that ends every record of an indented dump: a line break, the record's indent and its brace.

    ``head`` and ``tail`` are the ends of the file.  A record's closing brace
    stands under the line that opened it, everything inside stands deeper,
    and a JSON text holds no raw line break, so this separator is found at
    the ends of records only.  Raises ``ValueError`` for other layouts.
    """
    opening = re.match(_OPENING, head)
    closing = r"\]\s*\}\s*$" if opening and "{" in opening.group() else r"\]\s*$"
    if not opening or not re.search(closing, tail):
        raise ValueError("not a list of records, or cut off")
    first = re.match(r"(?:\s*\{\s*\}\s*,)*\s*\{[ \t]*(\r?\n)", head[opening.end():])
    if not first:
        if re.fullmatch(r"[\s{},]*" + closing, head[opening.end():]):
            return "\n\0"  # no record has a field; a separator that no JSON text holds
        raise ValueError("its records are not indented")
    line = head[:opening.end() + first.start(1)].rsplit("\n", 1)[-1]
    return first.group(1) + line[:len(line) - len(line.lstrip())] + "}"


def _dump_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files of ``path`` (one file, or a folder's) by their separator; reads the two ends of each, nothing between."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for st in fs.listStatus(root):
        name, size = st.getPath().getName(), st.getLen()
        if st.isDirectory() or name[0] in "._" or not size:
            continue
        stream = fs.open(st.getPath())
        try:
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, DUMP_HEAD)))
            stream.seek(max(0, size - DUMP_TAIL))
            tail = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, DUMP_TAIL)))
        finally:
            stream.close()
        try:
            sep = dump_separator(head.decode("utf-8", "ignore"), tail.decode("utf-8", "ignore"))
        except ValueError as e:
            raise ValueError(f"{st.getPath().toString()}: {e}; read_landed_payloads reads any layout") from None
        found.setdefault(sep, []).append(st.getPath().toString())
    return found


def _dump_piece(piece: Column) -> Column:
    """The list of whole records that one piece between separators stands for, as JSON text.

    A piece lacks the brace that its separator took.  The last piece of a
    file has no record with fields, hence no quote, and ends the list.
    """
    led = piece.rlike(_OPENING) | piece.rlike(r"^\s*,")
    body = F.regexp_replace(piece, f"{_OPENING}|^\\s*,", "")
    rest = F.regexp_replace(body, _CLOSING, "")
    last = F.when(piece.rlike(r"^\s*,") & rest.rlike(r"^\s*$"), F.lit("[,]")).otherwise(F.concat(F.lit("["), rest, F.lit("]")))
    return (F.when(~body.contains('"'), last).when(led, F.concat(F.lit("["), body, F.lit("}]")))
            .otherwise(F.concat(F.lit("no comma between records: "), F.substring(piece, 1, 200))))


def read_landed_dump(spark: SparkSession, path: str, record: T.StructType = PAYLOAD_RECORD) -> DataFrame:
    """SRC-03: large indented dumps of records, each file read by many tasks; one row per record.

    ``path`` is a file or a folder of them; a file holds an indented list of
    records, or ``{"data": [...]}`` around one and nothing else.  Gives the
    rows of ``read_landed_payloads``, which reads any layout, but a file in
    one task.  Here Spark's text source splits files into byte ranges at the
    separator found in the file's head (``dump_separator``), so a task holds
    one record at a time.  An empty file has no records.  Other layouts,
    compressed or cut files raise at once; malformed records fail the job.
    The driver opens every file at both ends: meant for few and large files.
    """
    parts = [spark.read.option("lineSep", sep).text(files) for sep, files in sorted(_dump_files(spark, path).items())]
    if not parts:
        return spark.createDataFrame([], record)
    pieces = reduce(DataFrame.unionAll, parts)
    docs = pieces.select(F.parse_json(_dump_piece(F.col("value"))).alias("doc"))
    return docs.select(F.explode(_landed_records(F.col("doc"), record)).alias("rec")).select("rec.*")


def batch_folders(spark: SparkSession, path: str, key: str) -> list[tuple[str, str]]:
    """Landed batch folders ``<path>/<key>=<value>`` as ``(value, folder)`` pairs.

    A metadata listing of one directory level on the driver (one entry per
    batch, not per row); every folder found is returned, so no batch is
    left out because its key was not foreseen.
    """
    from urllib.parse import unquote
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(key + "="):
            out.append((unquote(name[len(key) + 1:]), st.getPath().toString()))
    return sorted(out)


def read_batches(spark: SparkSession, path: str, key: str, schema: T.StructType,
                 fmt: str = "json") -> DataFrame:
    """SRC-03 + PRJ-05 + SET-01: every landed batch with its key stamped, in one scan.

    The folder key becomes the column, so any number of batches is one plan;
    the folder that Spark writes for a NULL key reads back as NULL.
    """
    found = batch_folders(spark, path, key)
    full = T.StructType(list(schema.fields) + [T.StructField(key, T.StringType())])
    if not found:
        return spark.createDataFrame([], full)
    return missing_nan(spark.read.format(fmt).schema(full).option("basePath", path)
                       .load([folder for _, folder in found]))


def records_frame(spark: SparkSession, records: Iterable[Mapping | tuple],
                  schema: T.StructType) -> DataFrame:
    """SRC-04: small in-memory records under a declared schema.

    For driver-sized input only (tests, dimension rows); data of any size
    is landed as files and read with ``read_landed_payloads``.
    """
    return spark.createDataFrame(list(records), schema)


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-04 at scale: cast columns to a declared schema by name.

    Fields declared non-null are checked row by row; a NULL fails the job
    instead of slipping through (the Parquet schema cannot carry the flag).
    """
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"NULL in required field {f.name}")).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_documents(spark: SparkSession, path: str, fmt: str = "json",
                   options: Mapping[str, str] | None = None, drop: tuple[str, ...] = ("_id",),
                   schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-06: a whole document collection, store key dropped; NaN is missing (S9).

    Without ``schema`` it is inferred from every document (exact, one extra
    pass); pass the schema at scale.
    """
    r = spark.read.format(fmt).options(**(options or {}))
    df = (r.schema(schema) if schema is not None else r).load(path)
    return missing_nan(df.drop(*[c for c in drop if c in df.columns]))
