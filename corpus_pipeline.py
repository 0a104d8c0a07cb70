"""A corpus from raw documents to packed sequences: cleaning, near-duplicate removal, decontamination, redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, ngram_join, packing, pii, quality
from millrace.llm.queries import encoder
from millrace.llm.sieve import without
from millrace.llm.staging import new_folder, release, remove, staged, staged_so_far


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, with their lines that pass. A filter on the verdict would be pushed below the
    projections and evaluate the rules anew; a text that fails is an empty list, which gives a row without a text, and these go. Null and blank
    texts go; repeated rows are judged each; null ids stay; a column named quality is dropped."""
    own = [c for c in docs.columns if c != "quality" and not c.startswith("_q_")]
    told = quality.assess(docs).select(*own, F.col("quality.kept").alias("_q_kept"), F.col("quality.clean_text").alias("_q_clean"))
    made = told.withColumn("_q_text", F.explode_outer(F.filter(F.array("_q_clean"), lambda x: F.col("_q_kept")))).filter("_q_text is not null")
    return made.withColumns({"text": F.col("_q_text"), "n_chars": F.length("_q_text").cast("long")}).select(own if "n_chars" in own else [*own, "n_chars"])


def _by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column of longs that names each row. That is doc_id if no row lacks it and none repeats it; else a copy of docs is
    written with numbers, which a lost task can't change."""
    ids = docs.groupBy("doc_id").count()
    if ids.filter("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name += "_"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, null last. Every row is judged by its own text, so
    rows of one id with other texts are other documents, equal rows are copies, and a null id is compared like any other.
    Rows without a word stay each."""
    rows, name = _by_row(docs)
    found = ngram_join.cluster(rows, key=name)
    if name != "doc_id":
        ids = rows.select(name, F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"))
        stay = found.join(ids, name).groupBy("component_id").agg(F.min(F.struct("_null", "_id", name))[name].alias(name))
        gone = found.join(stay, name, "left_anti")
    else:
        gone = found.filter("doc_id <> component_id")
    return without(rows, name, gone.select(name)).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark. Every row is judged by its own text: of rows with one id only those that hold
    an item go, and a null id doesn't save one."""
    rows, name = _by_row(docs)
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=name)
    return without(rows, name, found.select(name).distinct()).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null and empty texts stay as they are; repeated rows are changed
    each; every other column passes through."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens. Null texts count as empty; null ids stay null; repeated rows are packed
    each; other columns are left out."""
    return packing.pack(docs, encoder())


STAGES = [("quality", clean), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]

#: Tokenising, expectation-maximisation and BM25 are beyond SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table documents, each written as Parquet and read again by the next. What a stage wrote for itself,
    and the table it read, are removed when it is done."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder, since = new_folder(spark, f"pipeline-{name}"), staged_so_far()
        stage(spark, docs, sf_dir).write.parquet(folder)
        release(spark, since)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(folder), folder
    return docs
