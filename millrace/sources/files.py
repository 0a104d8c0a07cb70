"""Readers and writers of corpora: JSON lines, JSON documents, Parquet, tolerant crawls."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from millrace.sources import jsondocs
from millrace.sources.scratch import scratch

# Members of a JSON document's root that may hold its rows, in the order in which they are tried.
ROOT_KEYS = ("data", "examples", "events", "instances")


def _exists(spark: SparkSession, path: str) -> bool:
    own, store = _path(spark, path)
    return store.exists(own)


def require(spark: SparkSession, path: str, step: str = "fetch the data first") -> str:
    """path, or FileNotFoundError that names the step which makes it; any store that Spark can read."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: {step}")
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(require(spark, path))


def read_json_document(spark: SparkSession, path: str, key: str = "data", schema: str | None = None) -> DataFrame:
    """Rows of JSON documents of any size: those of a top-level list; else, the root being an object, of the list under key; else
    none. What the root of each file is decides, not what its rows hold; many tasks read a file, and none holds its list."""
    return _read_document(spark, path, key, schema).drop(*_PLACE)


def write_json_documents(items: DataFrame, path: str, head: str = "[", tail: str = "]") -> None:
    """Writes items (value, JSON texts) as documents of a list between head and tail, one file a partition of items. A task passes
    its items on as they come, and holds none of its document."""
    lines = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield lines([head])
        first = True
        for batch in batches:
            if batch.num_rows:
                own = pc.binary_join_element_wise(pa.scalar(","), batch.column(0).cast(pa.string()), "")
                yield lines([batch.column(0)[0].as_py(), *own[1:].to_pylist()] if first else own)
                first = False
        yield lines([tail])

    items.select("value").mapInArrow(run, "value string").write.text(path)


_PLACE = ("_file", "_block", "_place")


def _read_document(spark: SparkSession, path: str, key: str = "data", schema: str | None = None) -> DataFrame:
    return jsondocs.read_items(jsondocs.json_items(spark, require(spark, path), key), schema)


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a path by its kind: .jsonl, .json, else Parquet."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return read_json_document(spark, path, schema=schema)
    return spark.read.parquet(require(spark, path))


def read_slice(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows start to stop of a path in the order in which it is read."""
    if not start and stop is None:
        return read_rows(spark, path)
    if path.endswith(".json"):
        return sliced(_read_document(spark, path), start, stop, _PLACE).drop(*_PLACE)
    return sliced(read_rows(spark, path), start, stop)


#: Rows that one task may gather for a slice.
AT_ONCE = 10_000


def sliced(rows: DataFrame, start: int = 0, stop: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows start to stop, in an order, or as files are read.

    A short slice at the beginning is a limit. Else the rows of each partition are counted, so that a row's number is its place
    in the partition behind a known offset, and the slice is a filter; ordered rows are first written sorted by range. Without an
    order rows must be those of files, which every pass cuts into the same partitions. The slice's own rows come in no order.
    """
    if not start and stop is None:
        return rows
    if stop is not None and stop <= AT_ONCE:
        ordered = rows.orderBy(*order) if order else rows
        return (ordered.offset(start) if start else ordered).limit(max(0, stop - start))
    spark, own = rows.sparkSession, [F.col(f"`{c}`") for c in rows.columns]
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    placed = (rows.orderBy(*order) if order else rows).select(*own, part, place)
    if order:
        path = scratch(spark, "sorted")
        placed.write.parquet(path)
        placed = spark.read.parquet(path)
    before, offsets = 0, []
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        if before + r["n"] > start and (stop is None or before < stop):
            offsets.append((r["_part"], before))
        before += r["n"]
    known = F.broadcast(spark.createDataFrame(offsets, "_p int, _before long"))
    number = F.col("_before") + F.col("_at")
    inside = (number >= start) & (F.lit(True) if stop is None else number < stop)
    return placed.join(known, F.col("_part") == F.col("_p")).filter(inside).select(*own)


def tolerant_rows(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, place, raw) of all files of a crawl that are JSON throughout; one bad line drops its whole file. place grows with
    the lines of a file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("value").alias("raw")).filter(F.trim("raw") != "")
    bad = text.filter(F.try_parse_json("raw").isNull()).select("file").distinct()
    return text.join(bad, "file", "left_anti")


def tolerant_documents(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(file, place, raw) of the rows of JSON documents: a top-level list, or the first member of ROOT_KEYS that is one. Files that
    can't be parsed give none."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    root = F.try_parse_json("value")
    lists = F.coalesce(F.try_variant_get(root, "$", "array<variant>"), *[F.try_variant_get(root, f"$.{k}", "array<variant>") for k in ROOT_KEYS])
    place = F.struct(F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("row"))
    return whole.select("file", F.posexplode(lists).alias("pos", "item")).select("file", place.alias("place"), F.to_json("item").alias("raw"))


def usable_files(rows: DataFrame, yields: Column, least: int = 50) -> DataFrame:
    """(file, examples) of the files whose converter gives at least so many examples."""
    return rows.groupBy("file").agg(F.count_if(yields).alias("examples")).filter(F.col("examples") >= least)


def ordered_slice(rows: DataFrame, key: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows start to stop in the order of key, as a split slice takes them."""
    return sliced(rows, start, stop, [key])


def json_line(row: Column) -> Column:
    """A struct as one JSON object, nulls left out, text as it is."""
    return F.to_json(row)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(json_line(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).write.mode("overwrite").text(path)


def _path(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    own, store = _path(spark, path)
    store.delete(own, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Puts a written folder in the place of another; a source that isn't there leaves an empty folder."""
    remove(spark, target)
    (own, store), (there, _) = _path(spark, source), _path(spark, target)
    if not store.exists(own):
        store.mkdirs(there)
    elif not store.rename(own, there):
        raise OSError(f"{source} can't be moved to {target}")


def sft_input(rows: DataFrame) -> DataFrame:
    """Training rows without their source tag."""
    return rows.drop("source")


def dpo_input(pairs: DataFrame) -> DataFrame:
    """Pairs without their margin; none at all is an error. The look at the first pair reads no more than that needs where
    pairs are a table; made pairs should be written first."""
    out = pairs.drop("margin")
    if out.isEmpty():
        raise ValueError("no preference pairs; build them from an interaction log first")
    return out


def parquet_files(files: list[str], split: str, config: str | None = None) -> list[str]:
    """Of a repository's files, the Parquet ones of a split, sorted. The config must be a folder of the path, but is ignored
    if no file has it; the split must be part of the file's name. A folder named like a Parquet file, as Spark writes tables, is
    one file: its name counts, not those of its parts."""
    own = sorted(f for f in files if f.endswith(".parquet"))
    inside = [f for f in own if config in PurePosixPath(f).parts[:-1]] if config else []
    found = [f for f in (inside or own) if split in next(p for p in PurePosixPath(f).parts if p.endswith(".parquet"))]
    if not found:
        raise FileNotFoundError(f"no Parquet file of split {split!r} among {len(files)} files")
    return found


def repeat_passes(rows: DataFrame, passes: int, order: list[str], budget: int | None = None) -> DataFrame:
    """rows read so many times over, as a training loop does, up to budget rows; an empty source is an error.

    Whole passes are copies of each row, not joins; only the pass in which the budget ends is a slice, in the order given.
    """
    n = rows.count()
    if not n:
        raise RuntimeError("the source is empty; it would be repeated for ever")
    whole = passes if budget is None else min(passes, max(0, budget) // n)
    rest = 0 if whole == passes else max(0, budget) - whole * n
    number = F.explode(F.sequence(F.lit(0), F.lit(whole - 1))) if whole else F.lit(0)
    out = rows.withColumn("pass", number) if whole else rows.withColumn("pass", number).limit(0)
    return out.unionByName(sliced(rows, 0, rest, order).withColumn("pass", F.lit(whole))) if rest else out


def first_row(rows: DataFrame):
    """The first row, or ValueError."""
    found = rows.limit(1).collect()
    if not found:
        raise ValueError("the source has no rows")
    return found[0]


def split_stats(rows: DataFrame, text: str) -> DataFrame:
    """Rows, and those whose text is null or blank."""
    return rows.agg(F.count("*").alias("examples"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("empty_text"))


def inspect(rows: DataFrame, order: str, n: int = 5, width: int = 2000) -> DataFrame:
    """The first rows as JSON cut to a width."""
    return rows.orderBy(order).limit(n).select(F.substring(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])), 1, width).alias("preview"))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(require(spark, path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A short text as one file, in any store that Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def first_rows(spark: SparkSession, path: str, limit: int | None, schema: str | None = None) -> DataFrame:
    """The first limit rows of JSON lines, blank ones not counted; all of them without a limit."""
    return sliced(read_jsonl(spark, path, schema), 0, limit)


def reference_texts(rows: DataFrame, text: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The first transcripts in an order, missing ones as empty."""
    return sliced(rows, 0, limit, order).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """(examples): lines that aren't blank."""
    return spark.read.text(require(spark, path)).agg(F.count_if(F.trim("value") != "").alias("examples"))


def prepared(rows: DataFrame, prepare: Callable[[dict], dict], schema: str) -> DataFrame:
    """Every row through a callback, from a dictionary to one of the schema's columns, in Arrow batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if made := [prepare(r) for r in batch.to_pylist()]:
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in order} for r in made], schema=target)

    target = to_arrow_schema(_parse_datatype_string(schema))
    order = target.names
    return rows.mapInArrow(run, schema)
