"""Position reports in daily zip files: listing, reading, and a ledger of what has been taken in."""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Domain, raw_folder, store_folder
from ..functions.geo import file_date
from ..operators import clean
from ..operators.components import forget, settle

# Columns of the files, with our names and types.
COLUMNS = {
    "MMSI": ("mmsi", "BIGINT"),
    "BaseDateTime": ("base_date_time", "STRING"),
    "LAT": ("lat", "DOUBLE"),
    "LON": ("lon", "DOUBLE"),
    "SOG": ("sog", "DOUBLE"),
    "COG": ("cog", "DOUBLE"),
    "Heading": ("heading", "DOUBLE"),
    "VesselType": ("vessel_type", "INT"),
    "Status": ("status", "STRING"),
    "TransceiverClass": ("transceiver_class", "STRING"),
    "Length": ("length", "DOUBLE"),
    "Width": ("width", "DOUBLE"),
    "Draft": ("draft", "DOUBLE"),
}


def list_days(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(path, day, size, modified) of the zip files of a folder, by name only; contents are not read.

    With a first or last day only files of that range, both included; files
    without a date only count where no range is set.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "AIS_*.zip").load(folder).select("path", file_date(F.col("path")).alias("day"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if first is not None:
        found = found.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        found = found.where(F.col("day") <= F.lit(last).cast("date"))
    return found


def not_ingested(listing: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a listing that the ledger does not hold with the same keys."""
    return listing.join(ledger.select(*keys), keys, "left_anti")


RAW = T.StructType([T.StructField("path", T.StringType()), *[T.StructField(c, T.StringType()) for c in COLUMNS], T.StructField("n_rows", T.LongType()), T.StructField("problem", T.StringType())])


def read_days(spark: SparkSession, listing: DataFrame, chunk_rows: int = 200_000) -> DataFrame:
    """Raw rows, all text, of the first CSV in each listed zip.

    Each file ends with a row of its own: ``n_rows`` counts its rows, or ``problem`` says why it could not be read to its
    end. A file without such a row was not read to its end either.
    """
    folder_files = [r["path"] for r in listing.select("path").collect()]  # names of the days to take in
    if not folder_files:
        return spark.createDataFrame([], RAW)
    names = list(COLUMNS)

    def last(path: str, rows: int | None, problem: str | None) -> pd.DataFrame:
        out = pd.DataFrame([[path, *[None] * len(names), rows, problem]], columns=[x.name for x in RAW])
        return out.astype({"n_rows": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        member = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                        if member is None:
                            raise ValueError("no CSV inside")
                        with z.open(member) as f:
                            for chunk in pd.read_csv(f, dtype=str, chunksize=chunk_rows):
                                known = [c for c in names if c in chunk.columns]
                                if len(known) < 4 or "MMSI" not in known:
                                    raise ValueError("not a file of position reports")
                                plain = chunk.reindex(columns=names).astype(object)
                                plain = plain.where(plain.notna(), None)
                                rows += len(plain)
                                yield plain.assign(path=str(path), n_rows=pd.array([None] * len(plain), "Int64"), problem=None)[[x.name for x in RAW]]
                    yield last(path, rows, None)
                except Exception as problem:  # a file that cannot be read is told of, the others go on
                    yield last(path, None, f"{type(problem).__name__}: {problem}")

    return spark.read.format("binaryFile").load(folder_files).select("path", "content").repartition(len(folder_files), "path").mapInPandas(run, RAW)


def typed(raw: DataFrame) -> DataFrame:
    """Our columns and types, ``t`` in seconds; text that is no number or time is null; rows without identity, time or place go."""
    named = raw.where("problem IS NULL AND n_rows IS NULL") if "problem" in raw.columns else raw
    missing = [c for c in COLUMNS if c not in named.columns]
    named = named.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else named
    number = lambda c, kind: F.expr(f"try_cast(try_cast(`{c}` AS DOUBLE) AS {kind})") if kind in ("BIGINT", "INT") else F.expr(f"try_cast(`{c}` AS {kind})")
    cast = [number(c, kind).alias(ours) for c, (ours, kind) in COLUMNS.items()]
    at = F.try_to_timestamp(F.col("BaseDateTime"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    out = named.select(*cast, (F.unix_micros(at) / F.lit(1e6)).alias("t"), *(["path"] if "path" in named.columns else []))
    return clean.without_sentinels(out.dropna(subset=["mmsi", "t", "lon", "lat"]))


def load(spark: SparkSession, listing: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Typed reports of the listed days after the coarse domain filter, in order of time."""
    return clean.cheap_domain(typed(read_days(spark, listing)), domain).orderBy("t", "mmsi")


LEDGER = "file string, path string, size long, modified timestamp, batch string, rows_before long"
DISTRIBUTIONS = ("vessel_type", "transceiver_class", "status")


def existing(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table in a folder; None where there is none."""
    try:
        found = spark.read.schema(schema).parquet(folder) if schema else spark.read.parquet(folder)
        found.limit(0).count()
        return found
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def current(ledger: DataFrame) -> DataFrame:
    """Of each file the entry of the batch that was taken in last."""
    return ledger.groupBy("file").agg(F.max_by(F.struct("path", "size", "modified", "batch", "rows_before"), "batch").alias("e")).select("file", "e.*")


def stored(spark: SparkSession, target: str) -> DataFrame:
    """All reports that have been taken in: of each file those of its last whole reading, whatever days they are of."""
    ledger = existing(spark, f"{target}/ledger", LEDGER)
    if ledger is None:
        raise FileNotFoundError(f"nothing has been taken in at {target}")
    rows = existing(spark, f"{target}/reports")
    if rows is None:  # only files without reports so far
        return spark.createDataFrame([], ", ".join(f"{ours} {kind}" for ours, kind in COLUMNS.values()) + ", t double, file string, day date")
    return rows.join(current(ledger).select("file", "batch"), ["file", "batch"]).where("problem IS NULL AND n_rows IS NULL").drop("batch", "problem", "n_rows")


def ingest(spark: SparkSession, folder: str, target: str, domain: Domain = Domain(), first: str | None = None, last: str | None = None) -> int:
    """Take in files that are new or have changed; the number of files taken in.

    Reports go to ``target/reports``, a folder for each file, batch and day. Files never touch each other's folders, so two
    files of one day, or one without a date in its name, add up. The ledger is written after the data and names the batch
    that holds for each file; what no ledger entry names (a run that failed, a file that could not be read to its end, an
    older version of a file) is not part of ``stored`` and is deleted at the end. Unreadable files are named in
    ``target/problems`` and are tried again by each run, as they are not in the ledger. ``target/catalog`` holds a row for
    each day, written anew for the days that a run touches.
    """
    listing = list_days(spark, folder, first, last)
    ledger = existing(spark, f"{target}/ledger", LEDGER)
    todo = settle(listing if ledger is None else not_ingested(listing, current(ledger), ["path", "size", "modified"]))
    if todo.isEmpty():
        return 0
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # sorts by time
    raw = read_days(spark, todo)
    ends = F.col("problem").isNotNull() | F.col("n_rows").isNotNull()
    name = F.element_at(F.split("path", "/"), -1)
    marks = raw.where(ends).select(name.alias("file"), "n_rows", "problem")
    day = F.coalesce(file_date(F.col("path")), F.to_date(F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))))
    good = clean.cheap_domain(typed(raw), domain).withColumns({"file": name, "day": day}).drop("path")
    whole = good.unionByName(marks, allowMissingColumns=True).withColumn("batch", F.lit(batch))
    dealt = whole.repartition("file", "day").sortWithinPartitions("file", "day", "mmsi", "t")
    dealt.write.mode("append").partitionBy("file", "batch", "day").parquet(f"{target}/reports")
    fresh = settle(spark.read.parquet(f"{target}/reports").where((F.col("batch") == batch) & ends).select("file", "n_rows", "problem"))
    entries = todo.withColumn("file", name).join(fresh, "file")
    done = entries.where("problem IS NULL").select("file", "path", "size", "modified", F.lit(batch).alias("batch"), F.col("n_rows").alias("rows_before"))
    done.write.mode("append").parquet(f"{target}/ledger")
    entries.where("problem IS NOT NULL").select("file", "path", "size", "modified", F.lit(batch).alias("batch"), "problem").write.mode("append").parquet(f"{target}/problems")
    update_catalog(spark, target, batch)
    forget_old(spark, target, batch)
    return fresh.where("problem IS NULL").count()


def ingest_domain(spark: SparkSession, domain: Domain, raw: str, store: str, first: str | None = None, last: str | None = None) -> tuple[str, int]:
    """``ingest`` between the folders that the domain names, or those given: the store's folder and the number of files taken in."""
    target = store_folder(domain, store)
    return target, ingest(spark, raw_folder(domain, raw), target, domain, first, last)


def problems(spark: SparkSession, target: str) -> DataFrame:
    """(file, path, size, modified, batch, problem) of all files that could not be read, by run."""
    return spark.read.parquet(f"{target}/problems")


def update_catalog(spark: SparkSession, target: str, batch: str) -> None:
    """Write the manifests of all days anew that files of a batch have, or had before."""
    ledger = spark.read.schema(LEDGER).parquet(f"{target}/ledger")
    files = ledger.where(F.col("batch") == batch).select("file")
    kept = existing(spark, f"{target}/reports")
    if kept is None:
        return
    days = settle(kept.where("problem IS NULL AND n_rows IS NULL AND day IS NOT NULL").join(files, "file", "left_semi").select("day").distinct())
    rows = stored(spark, target).join(days, "day", "left_semi")
    fresh = day_manifests(rows, current(ledger)).join(days, "day", "right").fillna(0, ["rows_after"])
    fresh.withColumn("day_key", F.col("day").cast("string")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day_key").parquet(f"{target}/catalog")


def day_manifests(rows: DataFrame, files: DataFrame) -> DataFrame:
    """For each day its files, rows of these files before any filter, rows after, first and last time, and counts by value, null among them."""
    parts = [rows.groupBy("day", F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n")).groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(f"{c}_counts")) for c in DISTRIBUTIONS]
    whole = rows.groupBy("day").agg(F.count("*").alias("rows_after"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_distinct("mmsi").alias("vessels"))
    named = rows.select("day", "file").distinct().join(files.select("file", "rows_before"), "file").groupBy("day").agg(F.array_sort(F.collect_list("file")).alias("files"), F.sum("rows_before").alias("rows_before"))
    return reduce(lambda a, b: a.join(b, "day"), parts, whole.join(named, "day"))


def forget_old(spark: SparkSession, target: str, batch: str) -> None:
    """Delete the folders of batches, up to one, that no ledger entry names any more. A store has one writer at a time."""
    ledger = current(spark.read.schema(LEDGER).parquet(f"{target}/ledger")).select("file", "batch")
    rows = existing(spark, f"{target}/reports")
    if rows is None:
        return
    gone = rows.select("file", "batch").distinct().where(F.col("batch") <= batch).join(ledger, ["file", "batch"], "left_anti").collect()  # a row for each file of one run
    for r in gone:
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["file"])
        forget(spark, f"{target}/reports/file={name}/batch={r['batch']}")


def manifest(df: DataFrame, day: Column, time: str, vessel: str) -> DataFrame:
    """For each day its rows, first and last time, and vessels."""
    return df.groupBy(day).agg(F.count("*").alias("rows"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count_distinct(vessel).alias("vessels"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, rows) for each value of some columns, null among them."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("rows")).select(F.lit(c).alias("column_name"), "value", "rows") for c in columns]
    return reduce(DataFrame.union, parts)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A plain CSV of reports, typed, in order of time; rows without a valid time go."""
    return typed(spark.read.option("header", True).csv(path)).orderBy("t", "mmsi")


def counts_from_csv(spark: SparkSession, path: str, cluster_col: str = "cluster_id", rows: int = 50_000) -> DataFrame:
    """(mmsi, cluster_id, voyages): rows by vessel and route in a CSV's first ``rows`` rows."""
    head = spark.read.option("header", True).csv(path).limit(rows)
    return head.select(F.expr("try_cast(MMSI AS BIGINT)").alias("mmsi"), F.expr(f"try_cast(`{cluster_col}` AS INT)").alias("cluster_id")).dropna().groupBy("mmsi", "cluster_id").agg(F.count("*").alias("voyages"))
