"""Readings from CSV or Parquet, one shared table or one file per client."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.clients import assign_nodes_random, assign_rows_random
from wattline.sources.commits import Folder, append_part, read_parts

# while client files are replaced: where the new ones wait, and the list of what goes and what comes
BESIDE, REPLACING = "_parts-", "_replacing.json"
BAD = "_bad"
WEATHER = [
    "air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr", "sea_level_pressure",
    "wind_direction", "wind_speed",
]


def building_schema() -> str:
    """Schema of the building-energy readings."""
    lagged = [f"air_temperature_{m}_lag{n}" for n in (7, 73) for m in ("mean", "max", "min", "std")]
    cyclic = [f"{u}_{a}" for u in ("hour", "month", "weekday") for a in ("x", "y")]
    fields = [
        "building_id bigint", "timestamp timestamp", "meter_reading double", "anomaly int", "site_id int",
        "primary_use string", "square_feet double", "year_built double", "floor_count double",
        *[f"{c} double" for c in WEATHER + lagged + cyclic],
        "is_holiday int",
    ]
    return ", ".join(fields)


def check_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, keep_bad: bool = False) -> DataFrame:
    """Typed CSV: columns are found by header name, every file must carry the header of the first one.

    Columns that ``schema`` does not know are left out and never parsed.  With ``keep_bad`` a column of the text of every line that
    is malformed (a value of another type, a field too few or too many) goes along, null for the others; all columns are parsed then.
    """
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema.fields}
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).csv(paths).columns
    fields = [T.StructField(h, kinds.get(h.strip(), T.StringType())) for h in header]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if keep_bad:
        fields.append(T.StructField(BAD, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", BAD)
    typed = reader.schema(T.StructType(fields)).csv(paths)
    known = [h for h in header if h.strip() in kinds]
    columns = [*[F.col(f"`{h}`").alias(h.strip()) for h in known], F.col("_metadata.file_path").alias("_path")]
    if keep_bad:
        # a line is malformed only by what is parsed of it, so nothing of every column is added to its text
        nothing = F.substring(F.concat_ws("", *[F.col(f"`{h}`").cast("string") for h in header]), 1, 0)
        columns.append(F.concat(F.col(BAD), nothing).alias(BAD))
    return typed.select(*columns)


def reject_bad(df: DataFrame, rejects: str, most: float) -> DataFrame:
    """The well-formed rows of :func:`read_csv` with ``keep_bad``; the others go to the table ``rejects`` (file, line).

    A larger share of malformed lines than ``most`` is an error, and nothing is written then.  One pass counts, and a second
    one over the malformed lines only runs if there are any.  Reading a file again adds its lines once.
    """
    bad = F.col(BAD).isNotNull()
    told = df.groupBy("_path").agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("lines"))
    sums = told.agg(F.sum("bad").alias("bad"), F.sum("lines").alias("lines"), F.sum(F.xxhash64("_path", "bad", "lines").cast("decimal(38,0)")).alias("mark")).first()
    if sums["bad"]:
        if sums["bad"] > most * sums["lines"]:
            raise ValueError(f"{sums['bad']} of {sums['lines']} lines are malformed, more than a share of {most}")
        lines = df.where(bad).select(F.regexp_extract("_path", "([^/]*)$", 1).alias("name"), F.col("_path").alias("file"), F.col(BAD).alias("line"))
        append_part(lines, rejects, "name", f"{abs(int(sums['mark'])):x}")
    return df.where(~bad).drop(BAD)


def rejected_lines(spark: SparkSession, rejects: str) -> DataFrame:
    """Lines that readings were refused for: (file, line); empty before the first."""
    return read_parts(spark, rejects, "name string, file string, line string").drop("name")


def read_readings(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, target: str | None = None,
    fmt: str | None = None, rejects: str | None = None, most: float = 0.01,
) -> DataFrame:
    """One table with an explicit schema, from CSV or Parquet.

    Values of a CSV that do not fit become null; with ``rejects`` their lines go to that table instead, as long as their
    share is at most ``most``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("parquet" if all(p.rstrip("/").endswith(".parquet") for p in paths) else "csv")
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(*paths)
    elif rejects:
        df = reject_bad(read_csv(spark, paths, schema, True), rejects, most).drop("_path")
    else:
        df = read_csv(spark, paths, schema).drop("_path")
    return check_columns(df, [target] if target else [])


def read_client_files(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str | None = "data{n}.csv",
    clients: int | None = None, target: str | None = None, client: str = "client_id", rejects: str | None = None, most: float = 0.01,
) -> DataFrame:
    """One scan over all client files; client ``n - 1`` owns ``data<n>.csv`` (a file, or a folder
    ``file=data<n>.csv`` as written by :func:`write_client_parts`).

    ``clients`` demands files for 0…clients−1 and reads no others.  ``rejects`` and ``most`` as in :func:`read_readings`.  Without a pattern ``folder`` itself is the only file.
    """
    if not pattern:
        return read_readings(spark, folder, schema, target, None, rejects, most).withColumn(client, F.lit(0))
    finish_parts(spark, folder)
    glob = folder.rstrip("/") + "/{,file=}" + pattern.replace("{n}", "*")
    name = re.escape(pattern).replace(re.escape("{n}"), "([0-9]+)")
    df = read_csv(spark, glob, schema, rejects is not None)
    check_columns(df, [target] if target else [])
    if clients is not None:
        if clients < 1:
            raise ValueError(f"invalid number of clients {clients}")
        numbers = {int(m.group(1)) for f in df.inputFiles() if (m := re.search(name, f))}
        missing = [n for n in range(1, clients + 1) if n not in numbers]
        if missing:
            raise FileNotFoundError(f"no client file {[pattern.format(n=n) for n in missing]} in {folder}")
    number = F.regexp_extract("_path", name, 1).cast("int")
    if clients is not None:
        df = df.where(number.between(1, clients))  # a filter on the path: Spark leaves the other files alone
    if rejects is not None:
        df = reject_bad(df, rejects, most)
    return df.withColumn(client, number - 1).drop("_path")


def load_clients(
    spark: SparkSession, path: str, schema: T.StructType | str, mode: str, target: str, clients: int,
    node: str | None = None, key: str | None = None, pattern: str | None = "data{n}.csv", seed: int = 42, rejects: str | None = None, most: float = 0.01,
) -> DataFrame:
    """Readings with ``client_id``: ``shared`` splits one table by node (or by row), ``local`` has a file each."""
    if mode == "local":
        return read_client_files(spark, path, schema, pattern, clients, target, rejects=rejects, most=most)
    if mode != "shared":
        raise ValueError(f"unknown mode {mode!r}: expected 'shared' or 'local'")
    df = read_readings(spark, path, schema, target, None, rejects, most)
    return assign_nodes_random(df, node, clients, seed) if node else assign_rows_random(df, key, clients, seed)


def write_client_parts(
    df: DataFrame, folder: str, order: Sequence[str], client: str = "client_id", pattern: str = "data{n}.csv",
    rows_per_file: int = 5_000_000, fmt: str = "csv",
) -> None:
    """Replace the client files in ``folder`` by one folder of files per client; other files there stay.

    Range partitioning keeps a client's rows together in few files and still spreads a big client over
    many tasks.  All is written beside the old files first.  Then a list of what goes and what comes is put down in
    one step: before it the old files count, after it the new ones, and whoever comes next, reader or writer, ends
    what was begun.
    """
    spark = df.sparkSession
    place = Folder(spark, folder)
    finish_parts(spark, folder)
    beside = f"{BESIDE}{uuid.uuid4().hex}"
    before, after = pattern.split("{n}")
    named = df.withColumn(
        "file", F.concat(F.lit(before), (F.col(client) + 1).cast("string"), F.lit(after))
    ).repartitionByRange(client, *order)
    (
        named.drop(client)
        .write.partitionBy("file")
        .option("header", True)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .option("maxRecordsPerFile", rows_per_file)
        .format(fmt)
        .save(f"{place.path}/{beside}")
    )
    name = re.compile("(file=)?" + re.escape(pattern).replace(re.escape("{n}"), "[0-9]+"))
    old, new = ([n for n in place.names(where) if name.fullmatch(n)] for where in ("", beside))
    place.write(REPLACING, json.dumps({"beside": beside, "old": old, "new": new}))
    finish_parts(spark, folder)


def finish_parts(spark: SparkSession, folder: str) -> None:
    """End a replacement of client files that was decided; nothing to do where there is none.

    A new file that still lies beside has not come yet, so one of its name in the folder is old; the rest of
    the old names go.  Each step may be done again.
    """
    place = Folder(spark, folder)
    if not place.exists(REPLACING):
        return
    told = json.loads(place.read(REPLACING))
    waiting = [n for n in told["new"] if place.exists(f"{told['beside']}/{n}")]
    for n in told["old"]:
        if n in waiting or n not in told["new"]:
            place.delete(n)
    for n in waiting:
        place.move(f"{told['beside']}/{n}", n)
    place.delete(told["beside"])
    place.delete(REPLACING)
