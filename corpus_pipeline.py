"""From documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and
returns rows that are written as Parquet and read again as the next stage's docs. All but
the last return the columns of docs, whatever those are besides doc_id, text, lang and
source. Nulls in any column, empty texts, repeated rows and an empty table pass through
every stage; what becomes of them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmotion.llm.best_fit_packing import packed
from fieldmotion.llm.common import id_crc, rowed, stored
from fieldmotion.llm.hyper_language import identify, learn
from fieldmotion.llm.ngram_jaccard import near_duplicates
from fieldmotion.llm.systematic_mix import emitted, systematic_mix, word_count
from fieldmotion.llm.weak_rules import quality_rules

#: A text whose best cosine is no larger than chance between random vectors is in no known language.
LEAST_COSINE = 0.03


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept; null and empty texts go."""
    return quality_rules(docs).where("kept").select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learnt from those at hand; texts without a letter go."""
    prototypes = learn(docs.where(id_crc() % 4 != 2))
    found = identify(docs, prototypes, keep=tuple(docs.columns))
    names = [f"_{i}" for i in range(len(docs.columns))]
    found = found.toDF(*names, "_pred", "_score")
    return found.where((F.col("_pred") != "und") & (F.col("_score") >= LEAST_COSINE)).select(*names).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the first by doc_id (null last), then
    text, then the whole row; rows that repeat it in every column count once.
    """
    text, whole = F.xxhash64("text"), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), text.alias("text"), whole.alias("whole"))
    keyed = rowed(docs, key=key)
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text"))
    firsts = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("first")).distinct()
    return keyed.join(firsts, F.col("key") == F.col("first"), "left_semi").dropDuplicates(["key"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return emitted(systematic_mix(docs, word_count(F.col("text")), F.col("source"), F.col("doc_id")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; each copy of a document is packed."""
    return packed(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Stages fit models and pack online, which SQL cannot say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "pipeline-" + "-".join(name.lower().split()))
    return docs
