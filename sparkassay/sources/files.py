"""CSV, JSON and Parquet files, and folders of document collections."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions import values as V
from sparkassay.operators.ranks import new_folder

FILE_KINDS = ("csv", "json", "parquet")
#: The column in which Spark puts what it cannot parse.
CORRUPT = "_corrupt_record"


def file_kind(path: str) -> str:
    """The kind of a file by its extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FILE_KINDS:
        raise ValueError(f"unsupported file type: {path}")
    return kind


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. Without a schema the types are inferred in one extra scan."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False
) -> DataFrame:
    """JSON documents, one per line; `multiline` reads one document per file instead (a file is
    then one task's work, so large data belongs in lines). Where no line is a document of its own, the files are
    read as one document each without being told to; what is no JSON either way is an error."""
    reader = spark.read.option("multiLine", multiline)
    if schema:
        return reader.schema(schema).json(path)
    rows = reader.json(path)
    if CORRUPT not in rows.columns or not _nothing_else(spark, path, multiline):
        return rows
    if multiline or _nothing_else(spark, path, True):
        raise ValueError(f"no JSON documents, neither one a line nor one a file (multiline): {path}")
    return spark.read.option("multiLine", True).json(path)


def _nothing_else(spark: SparkSession, path: str, multiline: bool) -> bool:
    """True if no document can be parsed; columns that come from the names of folders aside."""
    return spark.read.option("multiLine", multiline).option("recursiveFileLookup", True).json(path).columns == [CORRUPT]


def _record_lists(fields: Sequence[T.StructField], path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.StructType]]:
    """Paths, through objects only, of the lists that hold objects."""
    for field in fields:
        here, kind = (*path, field.name), field.dataType
        if isinstance(kind, T.StructType):
            yield from _record_lists(kind.fields, here)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            yield here, kind.elementType


def flatten_documents(documents: DataFrame) -> DataFrame:
    """The objects inside the lists of nested documents as rows, joined by column name.

    Every list reached through objects contributes its elements; lists inside elements stay
    columns, scalars in lists are left out. All lists are brought to the same columns and unfolded
    together, so the documents are read once.
    """
    lists = list(_record_lists(documents.schema.fields))
    if not lists:
        raise ValueError("the documents hold no list of objects")
    columns = list(dict.fromkeys(name for _, kind in lists for name in kind.names))

    def rows(path: tuple[str, ...], kind: T.StructType) -> Column:
        nested: Column = V.col(path[0])
        for part in path[1:]:
            nested = nested.getField(part)

        def widened(element: Column) -> Column:
            return F.struct(
                *((element.getField(c) if c in kind.names else F.lit(None)).alias(c) for c in columns)
            )

        held = F.filter(nested, lambda element: element.isNotNull())
        return F.coalesce(F.transform(held, widened), F.array())

    return documents.select(F.inline(F.concat(*(rows(path, kind) for path, kind in lists))))


def read_json_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    return flatten_documents(read_json(spark, path, **options))


def read_file(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A file by its extension; `columns` limits what is read (None reads all). With a schema, CSV
    and JSON are not scanned for their types first. `multiline`: a JSON file is one document over
    several lines rather than a document a line."""
    kind = file_kind(path)
    if kind == "csv":
        df = read_csv(spark, path, schema)
    elif kind == "parquet":
        df = read_parquet(spark, path)
    else:
        documents = read_json(spark, path, schema, multiline)
        nested = any(True for _ in _record_lists(documents.schema.fields))
        df = flatten_documents(documents) if nested else documents
    return df if columns is None else df.select(*(V.col(c) for c in columns))


def open_file(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False
) -> dict[str, DataFrame]:
    """The one table of a file, named after it."""
    return {posixpath.basename(path.rstrip("/")): read_file(spark, path, schema=schema, multiline=multiline)}


def open_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Collections below a folder: `name/` or `name.json`, JSON lines."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for status in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")) and (status.isDirectory() or name.endswith(".json")):
            out[name.removesuffix(".json")] = read_json(spark, status.getPath().toString())
    return out


def table_schema(df: DataFrame) -> DataFrame:
    """Columns of a table as rows `(column, data_type, ordinal, present)`; `present` counts the
    cells that hold a value."""
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(i).alias("ordinal"),
            F.count_if(V.present(df, f.name)).alias("present"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*cells).alias("columns")).select(F.inline("columns"))


def document_fields(df: DataFrame, column: str | None = None) -> DataFrame:
    """Sorted names of the top-level fields over all documents: those of the JSON text in
    `column`, or the table's own columns in rows where they are present."""
    if column is not None:
        names = df.select(F.explode(F.json_object_keys(V.col(column))).alias("field"))
    else:
        held = [F.when(V.present(df, c), F.lit(c)) for c in df.columns]
        names = df.select(F.explode(F.array_compact(F.array(*held))).alias("field"))
    return names.distinct().orderBy("field")


def filter_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The listed columns (a list or one comma-separated text) that exist, in the order listed."""
    listed = keys.split(",") if isinstance(keys, str) else keys
    kept = [str(k).strip() for k in listed]
    return df.select(*(V.col(k) for k in kept if k in df.columns))


def write_filtered(df: DataFrame, keys: str | Sequence[str], folder: str | None = None) -> str:
    """Write the kept columns as JSON lines to a new folder; answers its path."""
    path = new_folder(df.sparkSession, "filtered") if folder is None else folder
    filter_keys(df, keys).write.json(path)
    return path
