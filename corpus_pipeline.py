"""The corpus pipeline: documents → language ID → exact dedup → n-gram Jaccard join → source mixing → packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netaudit.llm import language_id
from netaudit.llm.common import delete, free, join_groups, materialize, quoted, row_hashes, table, written
from netaudit.llm.exact_dedup import exact_groups, normal, once
from netaudit.llm.mixing import mix
from netaudit.llm.ngram_join import ngram_components
from netaudit.llm.packing import pack
from netaudit.llm.queries import tokenizer_path


#: Least share of a document's n-grams, corrected for false positives, that its language must hold. Of the held-out labelled rows
#: the lowest share was 0.626 on sf 0.1 (2499 rows) and 0.744 on sf 0.01 (249); random letters had 0.05 at most, foreign scripts 0.003.
LEAST_SCORE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language of the labels: those of which nothing can be told (`und`: no text, no letter) go, and those
    whose n-grams the filters of the best language hardly hold (score below LEAST_SCORE). Null and empty texts go, very long ones are judged
    whole, repeated rows go or stay together, and an empty table gives an empty result. Columns of any name stay as they are."""
    model = language_id.learn(docs)
    lang, score = free(docs, "lang_pred", "score")
    return language_id.identify(docs, model, docs.columns).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*quoted(docs.columns))


def _without(docs: DataFrame, marks: DataFrame, text: Column) -> DataFrame:
    """The rows of docs but those whose row_hashes stand in marks (r1, r2, copies, stays); of several rows with the hashes of one
    that stays, one stays."""
    r1, r2, t = free(docs, "_r1", "_r2", "_t")
    keyed = docs.select("*", once(text).alias(t)).select(*quoted(docs.columns), *[h.alias(n) for h, n in zip(row_hashes("doc_id", F.col(t)), (r1, r2), strict=True)])
    again = materialize(marks.where("stays AND copies > 1").select(F.col("r1").alias(r1), F.col("r2").alias(r2)))
    gone = marks.where("NOT stays OR copies > 1").select(F.col("r1").alias(r1), F.col("r2").alias(r2))
    left = keyed.join(gone, [r1, r2], "left_anti").select(*quoted(docs.columns))
    if again.isEmpty():
        return left
    row = free(docs, "_row")[0]
    one = keyed.join(again, [r1, r2], "left_semi").groupBy(r1, r2).agg(F.first(F.struct(*quoted(docs.columns))).alias(row))
    return left.unionByName(one.select(f"{row}.*"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one with the largest id, and one row of several that repeat it. Null texts
    are empty ones, and a null id is smaller than any other. An empty table gives an empty result. Columns of any name stay as they are."""
    found = exact_groups(docs)
    return _without(docs, found.select("r1", "r2", "copies", F.col("kept").alias("stays")), normal("text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of similarity 0.8 over five-word shingles connect: the one with the smallest id,
    of several with that id the one with the least hash, and one row of several alike in both. A null id is larger than any other. Null texts and texts
    without words are no copies and stay. An empty table gives an empty result. Columns of any name stay as they are."""
    rows = ngram_components(docs, n=5, percent=80).where("component IS NOT NULL").groupBy("component", "r1", "r2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    rows = materialize(rows.withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")))
    best = materialize(rows.groupBy("component").agg(F.min("order").alias("best"), F.count("*").alias("members")))
    marks = materialize(join_groups(rows, best, ["component"], "members").select("r1", "r2", "copies", (F.col("order") == F.col("best")).alias("stays"), "members").where("members > 1 OR copies > 1"))
    return _without(docs, marks, F.col("text"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reads the sources by tempered weights: every document at least once, none more than twice. A null source is one of its own; null and empty
    texts count one token; repeated rows are read alike. An empty table gives an empty result. Columns of any name stay as they are."""
    return mix(docs).select(*quoted(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; see pack for nulls, empty and very long texts, repeated rows and other columns."""
    return pack(docs, tokenizer_path())


STAGES = [("language ID", languages), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("source mixing", mixed_sources), ("packing", packed)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage but the last is written; then all tables that were written for it go, and the stage before it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with written() as paths:
            docs = materialize(stage(spark, docs, sf_dir))
        delete(spark, paths[:-1] + before)
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
