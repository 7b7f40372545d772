"""A corpus pipeline over documents: language, toxicity, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, and any further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, mixing, neardup, sentencepiece, toxicity
from strandline.llm.queries import PIECES
from strandline.llm.store import discard, free, written

#: A text whose best language is less sure than this is no text in a known language.
SURE = 0.3
#: Least Jaccard similarity, as a fraction, of near duplicates in the corpus; the query op1 has its own.
SIMILAR = 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay. Null texts, texts without a letter, and texts that fit no language go.

    Repeated rows are judged alike. Rows without a doc_id are judged too, but not learned from. No lang to learn from, no result.
    """
    net = langid.train(docs.where(langid.learnable(F.col("doc_id"))))
    found = langid.label(docs, net)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= SURE)).drop(lang, score)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled rows predicts toxic go.

    Null and empty texts have the score of a text without features, repeated rows equal scores. No label, nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = toxicity.learnable(F.col("doc_id"))
    weights = [(r["feature"], r["weight"]) for r in toxicity.train(docs.where(fold), labels.where(fold)).collect()]
    found = toxicity.score(docs, weights)
    score = found.columns[-1]
    return found.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: tuple[int, int] = neardup.THRESHOLD) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id. Of several rows of one doc_id one stays.

    Null, empty and blank texts are duplicates of nothing. Rows without a doc_id name no document: they stay, and drop no other.
    """
    found = neardup.near_duplicates(docs, threshold).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    name = free(docs.columns, "_marked")
    marked = written(found.where("not kept or rows > 1").select(F.col("doc_id").alias(name), "kept"), "dedup-marked")
    same = F.col(name) == F.col("doc_id")
    once = docs.join(marked.select(name), same, "left_anti")
    repeated = docs.join(marked.where("kept").select(name), same, "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(repeated)


def deduplicate_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """deduplicate() from the corpus's similarity SIMILAR on."""
    return deduplicate(spark, docs, sf_dir, SIMILAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix: it keeps its target weights until a source has no block left, later blocks follow.

    A null source is a source of its own. Null and equal doc_ids are rows like any other.
    """
    found = mixing.schedule(docs, ["doc_id"])
    position = found.columns[len(docs.columns) + mixing.ADDED.index("position")]
    order = [F.col(position), F.coalesce(F.col("source"), F.lit(""))]
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.drop(*ordered.columns[len(docs.columns) :])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every row. A null text has null tokens, an empty one none."""
    return sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"), sentencepiece.load(PIECES), carry=["doc_id", "lang", "source"])


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", deduplicate_corpus), ("mixing", mix), ("sentencepiece", tokens)]

#: No SQL expresses a trained network; tests compare each stage with a plain version of what it decides.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's table is deleted once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
