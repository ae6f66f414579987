"""A corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of documents.
Each gives rows for null texts (as empty), null and equal ids, repeated rows, empty tables and texts of any length as its docstring
and that of the operator that it calls say; columns that documents does not have pass through, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from obsidia.llm import common, packing, rules, simhash, subword, suffixes
from obsidia.llm.queries import END_ID, tokenizer_path

#: Bytes of a repeated passage that goes: about 50 words of short ones.
PASSAGE = 250
#: A document stays if its quality scores this or more.
QUALITY = 0.3
#: No SQL has the classifiers, the fingerprints' search or the tokenizer.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go, empty and null texts among them. An id does not matter."""
    return rules.filtered(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below QUALITY go; a null text scores as an empty one. An id matters only for the labels that it has."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return subword.filtered(docs, labels, "quality", subword.QUALITY, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, a null one counting as the largest; of equal rows one."""
    return simhash.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that occur again go, but for their first occurrence; n_chars follows the text, and a null text comes back empty."""
    return suffixes.cleaned(docs, PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids out of all documents in ascending order of ids, null ones first; a null text gives its end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), END_ID, 2048)


_used: list[str] = []


def _tidy(stage):
    """The stage, which first deletes what the one before it left in the shared folder: that one's result is written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(spark, _used)
        _used.clear()
        with common.scratch_of() as paths:
            out = stage(spark, docs, sf_dir)
        _used.extend(paths)
        return out

    return run


#: A stage's result must be written, as run() and any caller do that reread it, before the next one is called.
STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("quality classifier", _tidy(quality_classifier)),
    ("near-duplicates", _tidy(near_duplicates)),
    ("repeated passages", _tidy(repeated_passages)),
    ("packing", _tidy(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
