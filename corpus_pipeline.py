"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.spread import shared_folder
from panelloom.llm import lines, mixing, packing, quality, simhash
from panelloom.llm._spark import checkpointed, quoted, row_hash, whole_row


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, with all their columns.

    Null and empty texts have too few words and go; equal rows share their verdict; without labels of both kinds the base
    rules decide alone; an empty table gives an empty one.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines of repeated three-line windows; n_chars follows the text.

    No row goes: a null text stays null, a text of repeated lines alone becomes empty. Rows of one id are told apart by
    their texts, null ids come last, rows equal in both do not remove each other; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = lines.remove_repeated_lines(docs, carry=rest)
    return cut.select("doc_id", "text", *[F.col("row").getField(c).alias(c) for c in rest], F.length("text").cast("long").alias("n_chars")).select(*[quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id, a null id only where there is no other.

    Texts are linked at a Jaccard similarity of 0.8 of their sets of five-word shingles, which is computed for all
    candidates; those are found by twelve SimHash words, of whose 768 bits 150 may differ (116 do on average at 0.8,
    with a standard deviation of 10). Null and empty texts have no shingles and are alike; of rows with one id the one with
    the least text hash stays, of equal rows one; an empty table gives an empty one.
    """
    return simhash.one_of_each(docs, simhash.similar_texts(docs, similarity=0.8, k=5, words=12, max_bits=150))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mixture takes them; every row counts, with a null or a repeated id too.

    Rows are known by the hash of all their columns; rows equal in everything share the copies that they are given.
    Wordless texts are taken no time; a null source is a source of its own; an empty table gives an empty one.
    """
    weights = mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    row = row_hash(docs)
    mixed = mixing.mix_sources(docs, weights, row=row).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
    copies = checkpointed(mixed.agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n")).where("__copies > 0"))
    keyed = docs.select(whole_row(docs).alias("row"), row.alias("__key"), F.col("doc_id").cast("long").alias("__doc"))
    same = (F.col("__key") == F.col("__row")) & F.col("__doc").eqNullSafe(F.col("__id"))
    alone = keyed.join(copies.where("__n = 1"), same)
    several = keyed.join(copies.where("__n > 1"), same).dropDuplicates(["__doc", "__key"])
    taken = alone.unionByName(several)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long"))).alias("__copy")).select("row.*")


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document; a null text has length 0, repeated rows have places of their own, a null
    id is drawn by its text, an empty table gives an empty one."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("packing", length_packing),
]

#: The fitted classifier of the first stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
