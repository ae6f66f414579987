"""Hot, warm and cold storage of the core tables. Every tier is Parquet, keeps all columns and can be queried.

A table's folder is partitioned by tier and date. Ageing reads the files that hold rows which are due, and those alone, writes their rows
anew with a denser codec, and drops the files; a row's move is decided by its timestamp and as_of alone. Files that come in meanwhile
are not touched.

A move is a note in the folder _moves, which names the files that it adds and drops; it takes effect when the note is there, at once for
readers through read(). What it names is then put in place, and what a failure left undone is done by the next run. One run at a time.

A named batch of new rows is such a note too, so it is there as a whole or not at all; when its files are in place the note goes to the
folder _batches, and a batch that has a note in either folder is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ages at which rows move, in seconds, and days that plans keep.
WARM_AFTER, COLD_AFTER = 3600, 7 * 86400
RETENTION_DAYS = {"FREE": 30, "PRO": 90, "BUSINESS": 180, "ENTERPRISE": 365}
DEFAULT_DAYS = 30
CODECS = {"hot": ("snappy", None), "warm": ("zstd", "3"), "cold": ("zstd", "12")}


def retention_days(plan: str | None) -> int:
    return RETENTION_DAYS.get((plan or "").upper(), DEFAULT_DAYS)


def _at(as_of: datetime, seconds: int):
    return F.lit(as_of - timedelta(seconds=seconds)).cast("timestamp_ntz")


def assigned(df: DataFrame, as_of: datetime) -> DataFrame:
    """Adds tier, by age."""
    t = F.col("timestamp")
    return df.withColumn("tier", F.when(t < _at(as_of, COLD_AFTER), "cold").when(t < _at(as_of, WARM_AFTER), "warm").otherwise("hot"))


def retained(df: DataFrame, as_of: datetime, plan: str | None = None) -> DataFrame:
    """Rows that the plan keeps."""
    return df.where(F.col("timestamp") >= _at(as_of, retention_days(plan) * 86400))


def _write(rows: DataFrame, path: str, codec: str | None = None, level: str | None = None) -> None:
    """Rows with tier and date, ranged by date, service and time: a busy service's day is as many files as it has rows for, and footers skip by both."""
    ranged = rows.repartitionByRange("date", "service", "timestamp").sortWithinPartitions("date", "service", "timestamp")
    writer = ranged.write.mode("append").partitionBy("tier", "date")
    for option, value in (("compression", codec), ("parquet.compression.codec.zstd.level", level)):
        writer = writer.option(option, value) if value else writer
    writer.parquet(path)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"tier": F.lit("hot"), "date": F.to_date("timestamp")})


def append(df: DataFrame, path: str) -> None:
    """New rows, to the hot tier; sorted within files, so that footers skip by service and time."""
    _write(_dated(df), path)


def append_once(df: DataFrame, path: str, source: str, number: int, remembered: int = 100) -> None:
    """append() for batch `number` of a source: a batch that was written before, by a run that failed after it, is not written again.

    Of a source's batches the notes of the last `remembered` are kept: no source repeats what is longer ago.
    """
    jvm, fs, here = _files(df.sparkSession, path)
    name = f"{source}-{number:012d}"
    if not fs.exists(jvm.Path(here, f"_batches/{name}")) and not fs.exists(jvm.Path(here, f"_moves/{name}")):
        folder = jvm.Path(here, f"_incoming/{name}")
        fs.delete(folder, True)  # what a run that failed left there
        _write(_dated(df), folder.toString())
        add = [f[len(fs.makeQualified(folder).toString()) + 1 :] for f in _listed(fs, folder)]
        _note(jvm, fs, here, {"id": name, "from": f"_incoming/{name}", "batch": True, "add": add, "drop": []})
    _settle_one(jvm, fs, here, name, df.sparkSession)
    for old in fs.listStatus(jvm.Path(here, "_batches")):
        said = old.getPath().getName()
        if said.startswith(f"{source}-") and said[len(source) + 1 :].isdigit() and int(said[len(source) + 1 :]) < number - remembered:
            fs.delete(old.getPath(), False)


def _note(jvm, fs, here, move: dict) -> None:
    """Makes a move take effect."""
    note, hidden = jvm.Path(here, f"_moves/{move['id']}"), jvm.Path(here, f"_moves/.{move['id']}")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(move).encode()))
    out.close()
    if not fs.rename(hidden, note):
        raise RuntimeError(f"{note} could not be written")


def _settle_one(jvm, fs, here, name: str, spark: SparkSession) -> None:
    note = jvm.Path(here, f"_moves/{name}")
    if fs.exists(note):
        _place(jvm, fs, here, json.loads("\n".join(r.value for r in spark.read.text(note.toString(), wholetext=True).collect())))


def _place(jvm, fs, here, move: dict) -> None:
    """Puts a move that has taken effect in place; another that does so at the same time does no harm."""
    folder = move.get("from", f"_staged/{move['id']}")
    for name in move["add"]:
        staged, to = jvm.Path(here, f"{folder}/{name}"), jvm.Path(here, name)
        fs.mkdirs(to.getParent())
        if fs.exists(staged) and not fs.rename(staged, to) and not fs.exists(to):
            raise RuntimeError(f"{staged} could not be put in place")
    for name in move["drop"]:
        fs.delete(jvm.Path(name), False)
    note = jvm.Path(here, f"_moves/{move['id']}")
    if move.get("batch"):
        done = jvm.Path(here, f"_batches/{move['id']}")
        fs.mkdirs(done.getParent())
        if not fs.rename(note, done) and not fs.exists(done):
            raise RuntimeError(f"{note} could not be put away")
        fs.delete(jvm.Path(here, folder), True)
    else:
        fs.delete(note, False)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    here = jvm.Path(path.rstrip("/"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, fs, fs.makeQualified(here)


def _listed(fs, folder) -> list[str]:
    """All data files below a folder."""
    if not fs.exists(folder):
        return []
    found, files = fs.listFiles(folder, True), []
    while found.hasNext():
        name = found.next().getPath()
        if not name.getName().startswith(("_", ".")):
            files.append(name.toString())
    return files


def _moves(spark: SparkSession, path: str) -> list[dict]:
    """Moves that have taken effect and are not all in place."""
    jvm, fs, here = _files(spark, path)
    folder = jvm.Path(here, "_moves")
    if not fs.exists(folder):
        return []
    names = [f.getPath().toString() for f in fs.listStatus(folder) if not f.getPath().getName().startswith(".")]
    return [json.loads("\n".join(r.value for r in spark.read.text(n, wholetext=True).collect())) for n in sorted(names)]  # each names its own files


def _settle(spark: SparkSession, path: str) -> None:
    """Puts moves in place that have taken effect, and drops what others left behind."""
    jvm, fs, here = _files(spark, path)
    for move in _moves(spark, path):
        _place(jvm, fs, here, move)
    fs.delete(jvm.Path(here, "_staged"), True)


def due(spark: SparkSession, path: str, as_of: datetime, plan: str | None = None) -> list[str]:
    """The files with a row that is in another tier by now or that the plan does not keep. Dates that can't be due are not read."""
    latest = [(F.col("tier") == t) & (F.col("date") <= F.to_date(_at(as_of, s))) for t, s in (("hot", WARM_AFTER), ("warm", COLD_AFTER))]
    old = F.col("date") <= F.to_date(_at(as_of, retention_days(plan) * 86400))
    rows = spark.read.parquet(path).where(latest[0] | latest[1] | old).withColumn("file", F.col("_metadata.file_path"))
    kept = F.col("timestamp") >= _at(as_of, retention_days(plan) * 86400)
    moved = assigned(rows.withColumnRenamed("tier", "was"), as_of).where((F.col("was") != F.col("tier")) | ~kept)
    return sorted(unquote(r.file) for r in moved.select("file").distinct().collect())  # names of files, not rows; Spark gives them quoted


def run(spark: SparkSession, path: str, as_of: datetime, plan: str | None = None) -> DataFrame:
    """Moves what has aged, drops what the plan does not keep, and returns tier, rows and bytes of what the table then has.

    A run that fails leaves the table as it was, or with a move that the next run puts in place.
    """
    _settle(spark, path)
    files = due(spark, path, as_of, plan)
    if not files:
        return sizes(spark, path)
    jvm, fs, here = _files(spark, path)
    name = uuid.uuid4().hex
    staged = jvm.Path(here, f"_staged/{name}")
    rows = spark.read.option("basePath", here.toString()).parquet(*files)
    now = retained(assigned(rows.drop("tier"), as_of), as_of, plan).withColumn("date", F.to_date("timestamp"))
    for tier, (codec, level) in CODECS.items():
        _write(now.where(F.col("tier") == tier), staged.toString(), codec, level)
    add = [f[len(fs.makeQualified(staged).toString()) + 1 :] for f in _listed(fs, staged)]
    _note(jvm, fs, here, {"id": name, "add": add, "drop": files})
    _settle(spark, path)
    return sizes(spark, path)


def _all(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, with moves that have taken effect and are not in place yet."""
    moves = _moves(spark, path)
    if not moves:
        return spark.read.parquet(path)
    _, fs, here = _files(spark, path)
    base, gone = here.toString(), {f for m in moves for f in m["drop"]}
    dropped = {f.replace("file:///", "file:/") for f in gone}
    parts = [spark.read.option("basePath", base).parquet(*stay)] if (stay := [f for f in _listed(fs, here) if f.replace("file:///", "file:/") not in dropped and not any(f"/{x}/" in f for x in ("_staged", "_moves", "_incoming", "_batches"))]) else []
    for m in moves:
        folder = f"{base}/{m.get('from', f'_staged/{m["id"]}')}"
        there = [f"{folder}/{a}" for a in m["add"] if f"{base}/{a}" not in stay]
        parts += [spark.read.option("basePath", folder).parquet(*there)] if there else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """All tiers of a table. A span of time also prunes dates."""
    df = _all(spark, path)
    for bound, sign in ((start, ">="), (end, "<")):
        if bound is not None:
            t = F.lit(bound).cast("timestamp_ntz")
            df = df.where((F.col("date") >= F.to_date(t)) & (F.col("timestamp") >= t) if sign == ">=" else (F.col("date") <= F.to_date(t)) & (F.col("timestamp") < t))
    return df.drop("date")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """tier, rows and the bytes of its files, from their footers."""
    return footers(spark, path).groupBy("tier").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


_FOOTER = "tier string, file string, rows long, bytes long, packed long, unpacked long, oldest timestamp_ntz, newest timestamp_ntz"


def footers(spark: SparkSession, path: str, column: str = "timestamp") -> DataFrame:
    """A row a file: tier, file, rows, bytes, bytes of its columns packed and unpacked, and the oldest and newest of a column.

    From the files' footers, which tasks read, a file each; no page of data is. Where a footer has no bounds, as of empty files and of
    columns that are all null, they are null. Files of a move that is not in place yet are not among them.
    """
    named = spark.read.parquet(path).select("tier", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()  # no column of data: rows are counted by footers

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tier, file, size in zip(*(batch.column(c).to_pylist() for c in ("tier", "file", "bytes")), strict=True):
                fs, at = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(at) as f:
                    meta = pq.read_metadata(f)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                columns = [g.column(i) for g in groups for i in range(g.num_columns)]
                stats = [c.statistics for c in columns if c.path_in_schema == column and c.statistics is not None and c.statistics.has_min_max]
                bounds = (min(x.min for x in stats), max(x.max for x in stats)) if stats and isinstance(stats[0].min, datetime) else (None, None)
                out.append((tier, file, meta.num_rows, size, sum(c.total_compressed_size for c in columns), sum(c.total_uncompressed_size for c in columns), *bounds))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(_KINDS), _KINDS.values(), strict=True)], list(_KINDS))

    return named.mapInArrow(read, _FOOTER)


_KINDS = {"tier": pa.string(), "file": pa.string(), "rows": pa.int64(), "bytes": pa.int64(), "packed": pa.int64(), "unpacked": pa.int64(), "oldest": pa.timestamp("us"), "newest": pa.timestamp("us")}


def stored(spark: SparkSession, path: str) -> DataFrame:
    """tier, files, rows, bytes, packed, unpacked, saved_percent, oldest and newest of a table, from its files' footers."""
    sums = [F.sum(c).alias(c) for c in ("rows", "bytes", "packed", "unpacked")]
    grouped = footers(spark, path).groupBy("tier").agg(F.count("*").alias("files"), *sums, F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
    return grouped.withColumn("saved_percent", F.when(F.col("unpacked") > 0, (1 - F.col("packed") / F.col("unpacked")) * 100).otherwise(0.0))


def tier_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table, tier and rows of tables that have a tier column."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("tier").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "tier", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def block_stats(blocks: DataFrame) -> DataFrame:
    """By data_type, and in all as a row without one: blocks, bytes before and after, the average ratio, per cent saved."""
    grouped = blocks.rollup("data_type").agg(F.count("*").alias("blocks"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), F.avg("compression_ratio").alias("avg_ratio"))
    return grouped.withColumn("saved_percent", F.when(F.col("original") > 0, (1 - F.col("compressed") / F.col("original")) * 100).otherwise(0.0))
