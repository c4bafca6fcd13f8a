"""The corpus pipeline: documents to token files in five stages, each on all that the stage before kept.

Every stage bears null ids, texts, sources and languages, empty and very long texts, repeated rows and ids, an empty table, and columns of any
name beside its own. A null or empty text is judged as an empty one: quality gives it the score of empty texts, near duplicates and
decontamination find nothing in it, the mix takes no words of it. Quality and decontamination judge each row by its text, near duplicates by
row where ids repeat (a row without an id stays); the mix and the token files take every row. Of documents that tie for a group's
place the smallest id stays. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, mixing, queries, ranking, similar, tokens
from orbweave.llm.common import sized, stored


def mark() -> Column:
    """What tells a text from others, whatever its id."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("mark")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row of docs as one struct ``row`` beside other columns, so that its columns' names meet no other."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def without(docs: DataFrame, gone: DataFrame, by_text: bool = False) -> DataFrame:
    """docs less the rows whose doc_id is in ``gone``, null ids apart; ``by_text``: less the rows whose text has its ``mark`` there."""
    if by_text:
        marks = stored(gone.select(F.col("mark").alias("gone")).distinct(), "pipeline-gone")
        return packed(docs, mark()).join(sized(marks), F.col("mark") == F.col("gone"), "left_anti").select("row.*")
    ids = stored(gone.filter("doc_id is not null").select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    return packed(docs, F.col("doc_id").alias("id")).join(sized(ids), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality ranking rejects. Scores depend on texts alone, so each row goes or stays by its own text."""
    marked = docs.select("doc_id", "text", mark())
    return without(docs, ranking.scored(marked, queries.table(spark, sf_dir, "labels"), more=("mark",)).filter("predicted = 0"), by_text=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (five words, similarity 0.8 or more).

    Where ids repeat, each row is a document of its own: rows are numbered, and the first row of each group stays, so that a clean row
    doesn't go for what another row of its id is. Rows without an id have no group and stay.
    """
    similar_to = lambda rows: similar.linked_documents(rows, k=5, percent=80, extra=0.5)
    ids = docs.agg(F.count("doc_id").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        return without(docs, similar_to(docs).filter("doc_id != component_id"))
    named = packed(docs.filter("doc_id is not null"), F.col("text"), F.monotonically_increasing_id().alias("doc_id"))
    named = stored(named, "pipeline-numbered")  # numbers that a task run again can't change
    gone = similar_to(named.select("doc_id", "text")).filter("doc_id != component_id")
    return without(named, gone).select("row.*").union(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; each row goes or stays by its own text."""
    found = decontaminate.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter(F.size("items") > 0), by_text=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken."""
    return mixing.mixed_texts(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and each document's place in them."""
    return tokens.read_tokens(tokens.write_tokens(docs, queries.vocabulary()))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]

#: Tokenisation and learned scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
