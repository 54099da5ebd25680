"""Import and export: JSON lists, CSV with typed cells, document folders and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

META = ("_version", "_createdAt", "_updatedAt")
INT, DECIMAL, FLAG = r"^-?\d+$", r"^-?\d*\.\d+$", r"^(true|false)$"


def format_of(path: str) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("json", "csv"):
        raise EngineError(f"{path}: the format is told by .json or .csv")
    return kind


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects (anything else in it is left out), or an object a line as ``write`` leaves them."""
    first = spark.read.text(path).where("trim(value) <> ''").head(1)
    whole = not first or first[0]["value"].lstrip().startswith("[")
    df = spark.read.option("multiLine", whole).option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in df.columns else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row, then cells typed by their form; a column takes the type that all its cells have, else text."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', quote='"')
    raw = raw.select([F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in raw.columns])
    checks = {}
    for i, c in enumerate(raw.columns):
        col = F.col(f"`{c}`")
        for name, pattern in (("i", INT), ("d", rf"{INT}|{DECIMAL}"), ("b", FLAG), ("a", r"^\[")):
            checks[f"{name}{i}"] = F.coalesce(F.bool_and(col.rlike(pattern)), F.lit(False))
    seen = raw.agg(*[v.alias(k) for k, v in checks.items()]).first() if checks else {}
    out = []
    for i, c in enumerate(raw.columns):
        col = F.col(f"`{c}`")
        kind = "bigint" if seen[f"i{i}"] else "double" if seen[f"d{i}"] else "boolean" if seen[f"b{i}"] else None
        typed = col.try_cast(kind) if kind else F.from_json(col, "array<string>") if seen[f"a{i}"] else col
        out.append(typed.alias(c))
    return raw.select(out)


def _cell(f: T.StructField):
    col = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def write(df: DataFrame, path: str) -> None:
    """One file a partition below path: JSON lines' objects or CSV with a header; null is an empty cell."""
    if format_of(path) == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        df.select([_cell(f).alias(f.name) for f in df.schema.fields]).write.mode("overwrite").csv(path, header=True, escape='"')


def read(spark: SparkSession, path: str) -> DataFrame:
    """What ``write`` or another tool left at path, without metadata."""
    df = read_json(spark, path) if format_of(path) == "json" else read_csv(spark, path)
    return df.drop(*[c for c in META if c in df.columns])


def document_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON file a document; files whose name is not their document's id are left out."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", "[!_.]*.json").json(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return df.where(stem == F.col("id"))


def document_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log of {n, op, id, doc}: the last entry of an id wins, deletions drop it."""
    df = spark.read.json(path)
    last = Window.partitionBy("id").orderBy(F.desc("n"))
    return df.withColumn("__r", F.row_number().over(last)).where("__r = 1 and op = 'put'").select("doc.*")
