"""Readers and writers of compound tables and structure files."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molloom.operators.transform import number_rows, standardize_columns, union_all

# Column names under which ids and structures come.
IDS, SMILES = ["BB_ID", "id", "ID", "vendor_id", "VENDOR_ID"], ["SMILES", "smiles"]


#: Where a row stands in its files: by path, then by block, then in reading order.
PLACE = "struct(_metadata.file_path, _metadata.file_block_start, monotonically_increasing_id() AS at)"


def read_compounds(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None, schema: str | None = None, limit: int = -1) -> DataFrame:
    """A delimited file with a header; all columns are text unless a schema is given. limit: rows in file order, -1 for all."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if limit >= 0:
        df = df.withColumn("__place", F.expr(PLACE)).orderBy("__place").limit(limit).drop("__place")
    return df.select(columns) if columns else df


#: Files whose first lines are read at once.
OPEN_FILES = 16


def csv_files(spark: SparkSession, folder: str, pattern: str = "*.csv", sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """The files of a folder by header, in order of path. Files come from the folder's listing, headers from first lines
    alone; an empty file has the header ()."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = where.getFileSystem(conf).globStatus(where) or []
    paths = sorted(x.getPath().toString() for x in found if x.isFile())

    def header(path: str) -> tuple[str, ...]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).open(at)
        try:
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        return tuple(x.strip() for x in next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), ())) if line else ()

    with ThreadPoolExecutor(OPEN_FILES) as pool:
        headers = list(pool.map(header, paths))
    out: dict[tuple[str, ...], list[str]] = {}
    for path, names in zip(paths, headers):
        out.setdefault(names, []).append(path)
    return out


def _by_header(spark: SparkSession, files: dict[tuple[str, ...], list[str]], aliases: dict[str, list[str]], more: list[str]) -> DataFrame:
    """All rows of the files, one scan a distinct header: the aliased columns, more (null where a file has none) and __place."""
    parts = []
    for names, paths in files.items():
        if not names:
            continue
        schema = ", ".join(f"`{n}` string" for n in names)
        df = spark.read.schema(schema).option("header", True).csv(paths).withColumn("__file", F.col("_metadata.file_name")).withColumn("__place", F.expr(PLACE))
        df = standardize_columns(df, aliases)
        if lacking := [a for a in aliases if a not in df.columns]:
            raise ValueError(f"no column for {', '.join(lacking)} in {paths[0]}")
        parts.append(df.select(*aliases, *(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in more), "__file", "__place"))
    if not parts:
        columns = ", ".join(f"`{c}` string" for c in [*aliases, *more, "__file"])
        return spark.createDataFrame([], f"{columns}, __place int")
    return union_all(parts, drop_incomplete=False)


def read_blocks(spark: SparkSession, folder: str, scheme: str, spec: str | None = None, more: list[str] | None = None, ids: list[str] = IDS, smiles: list[str] = SMILES) -> DataFrame:
    """(cycle, bb_id, smiles) of the files <scheme>[.<spec>].BB<n>.csv in a folder, each id of a cycle once (its first row).

    Every file is read under its own header, with any of the names in ids and smiles. more: further columns to keep.
    """
    start = f"{scheme}.{spec}" if spec else scheme
    extra = list(more or [])
    rows = _by_header(spark, csv_files(spark, folder, f"{start}.BB*.csv"), {"bb_id": ids, "smiles": smiles}, extra)
    cycle = F.regexp_extract(F.col("__file"), r"\.(BB[0-9]+)\.[^.]*$", 1)
    rows = rows.withColumn("cycle", cycle).where("cycle <> ''")
    first = rows.groupBy("cycle", "bb_id").agg(F.min_by(F.struct("smiles", *extra), "__place").alias("r"))
    return first.select("cycle", "bb_id", *(F.col("r")[c].alias(c) for c in ("smiles", *extra)))


def read_folder(spark: SparkSession, folder: str, complete: bool = True, ids: list[str] = IDS, smiles: list[str] = SMILES) -> DataFrame:
    """(bb_id, smiles) of all CSV files in a folder, each under its own header, without the rows that lack one of them unless
    complete is False."""
    out = _by_header(spark, csv_files(spark, folder), {"bb_id": ids, "smiles": smiles}, []).select("bb_id", "smiles")
    return out.dropna() if complete else out


def read_sdf(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """(record, molblock, props map, names array) of the records of SD files; records without a mol block end are skipped.

    record counts the records from 0 in file order; limit: so many of them, -1 for all. Lines may end with CR and LF.
    A property header directly after a value (its blank line missing) is still found. names: the properties as they
    stand in the record. Equal names: the last value stays.
    """
    rows = spark.read.option("lineSep", "$$$$").text(path).select(F.regexp_replace("value", "\r\n", "\n").alias("value"), F.expr(PLACE).alias("__place"))
    # what is left of the mark's line goes, unless an empty title stands there: three lines before the counts line
    value = F.regexp_replace("value", r"^\n(?!(?:[^\n]*\n){2}[^\n]*V[23]000)", "")
    rows = rows.withColumn("value", value).where(F.instr("value", "M  END") > 0)
    if limit >= 0:
        rows = rows.orderBy("__place").limit(limit)
    rows = number_rows(rows, ["__place"], "record")
    # only a line `> ... <name>` is a header: values may start with, or hold, such a sign
    tail = F.regexp_replace(F.substring_index("value", "M  END", -1), r"\n(?=>[^<\n]*<[^>\n]+>[^\n]*\n)", "\n\n")
    found = F.regexp_extract_all(tail, F.lit(r"(?s)(?<=\n)>[^<\n]*<([^>\n]+)>[^\n]*\n(.*?)(?=\n\n|\n*$)"), 0)
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"<([^>\n]+)>", 1).alias("k"), F.rtrim(F.regexp_extract(x, r"(?s)>[^\n]*\n(.*)", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    block = F.concat(F.substring_index("value", "M  END", 1), F.lit("M  END"))
    return rows.select("record", block.alias("molblock"), F.map_from_arrays(names, last).alias("props"), names.alias("names"))


def properties(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """SD properties as columns beside record and molblock; by default all names, as they first occur in the file.

    A record without a property has null. Only the distinct names are collected; they become columns.
    """
    if names is None:
        seen = df.select("record", F.posexplode("names").alias("at", "name")).groupBy("name").agg(F.min(F.struct("record", "at")).alias("first"))
        names = [r[0] for r in seen.orderBy("first").select("name").collect()]
    return df.select("record", "molblock", *(F.col("props")[n].alias(n) for n in names))


def write_split(df: DataFrame, path: str, flag: Column, name: str = "status") -> None:
    """CSV files in one folder for each value of the flag."""
    df.withColumn(name, flag).write.partitionBy(name).option("header", True).csv(path)


def append_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Adds rows to a folder of CSV files; each file has the header once, and those that are there stay as they are."""
    df.write.mode("append").option("header", True).option("sep", sep).csv(path)


def append_once(df: DataFrame, path: str, batch: int, keys: list[str] | None = None) -> None:
    """Adds a batch to a folder of Parquet files, once: a batch that comes again replaces its own files and changes nothing else.

    With keys only the first row of each key stays: of a batch its least by the other columns, and none that a batch with a lower
    number has. So a replay of any batch, in any state of the folder, gives the rows that it gave before.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in (keys or [])]
    if keys:
        df = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*(F.col("__r")[c].alias(c) if c in rest else c for c in df.columns)) if rest else df.distinct()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        before = [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < batch]
        if before:
            known = spark.read.option("basePath", path).parquet(*before).select(*(F.col(k).alias(f"__{k}") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            df = df.join(known, same, "left_anti")
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def export_lists(df: DataFrame, path: str, name: str = "list", key: str = "bb_id") -> None:
    """CSV files in one folder for each list, each id of a list once (its least row by the other columns)."""
    rest = [c for c in df.columns if c not in (name, key)]
    once = df.groupBy(name, key).agg(F.min(F.struct(*rest)).alias("__r")) if rest else df.distinct()
    once = once.select(name, key, *(F.col("__r")[c].alias(c) for c in rest)) if rest else once
    once.repartition(name, F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").partitionBy(name).option("header", True).csv(path)


def read_patterns(spark: SparkSession, path: str, column: str = "SMILES") -> list[str]:
    """The patterns of a filter list (a CSV file with a header), in file order, each once; they become one expression."""
    rows = spark.read.option("header", True).csv(path).select(F.col(column).alias("p"), F.expr(PLACE).alias("__place")).where("p IS NOT NULL")
    return [r[0] for r in rows.groupBy("p").agg(F.min("__place").alias("at")).orderBy("at").select("p").collect()]
