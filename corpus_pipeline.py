"""Corpus pipeline: toxicity, exact duplicates, near duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
result of each stage is written as Parquet to the shared folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from weft.llm.common import free_name, stored

#: Target share of expected tokens by predicted quality.
WEIGHTS = {"0": 0.1, "1": 0.9}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; null, empty and wordless texts stay; rows that repeat an id are judged one by one."""
    machine = toxicity.train(docs, _labels(spark, sf_dir))
    name = free_name(docs.columns, "score")
    return toxicity.score(docs, machine, column=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space (null is empty): the longest, then the smallest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest id.

    Null ids, and texts without words, are near copies of nothing and stay.
    """
    found = near_dedup.link_classes(docs, k=5)
    gone = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and as often as its fitted rate says.

    Copies are rows like the document's own and are dealt to different partitions, one after the other from a hash of the
    id, so that packing, which works inside partitions, does not put them side by side. Wordless and null texts and null ids
    keep the rate they start with (1); rows that repeat an id are repeated one by one; ties cannot arise.
    """
    out, report = mixing.mix(docs, _labels(spark, sf_dir), weights=WEIGHTS, least=1.0, carry=True)
    copies = report["columns"][-1]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = free_name(docs.columns, "place")
    out = out.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.greatest(F.col(copies), F.lit(1)) - 1)).alias(place))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("place")) + F.col(place), F.lit(parts)).cast("int")
    return out.repartitionById(parts, apart).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024, 2048, 4096 or 8192 words; null and wordless texts ride with length 0, null ids stay null in the
    lists, rows that repeat an id are packed one by one."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages train classifiers and fit rates: not expressible in SQL.
ORACLE_SQL = None
