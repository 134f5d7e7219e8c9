"""The corpus pipeline: five stages, each calling one operator of skerry.llm.

All stages but the last return the columns of documents; where a stage rewrites
text, n_chars follows. The last returns the packed pieces. No SQL can express
the stages; tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import neardup, packing, passages, pii, toxicity
from skerry.llm.queries import vocabulary_path
from skerry.llm.textops import cut, nested, read_table, restored

#: The key of the pseudonyms; a deployment passes its own.
PII_KEY = b"a key for tests"
ORACLE_SQL = None


def _rewritten(found: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of docs with another text, and n_chars after it."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return restored(found, docs.columns, **new)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, doesn't reject."""
    return toxicity.reject(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return neardup.keep_one(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words that stand earlier are cut; other documents keep their text as it is."""
    found = passages.dedup(nested(docs), k=20)
    return _rewritten(found, docs, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms."""
    return _rewritten(pii.pseudonymise(nested(docs), PII_KEY), docs, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("personal data", hide_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Each one's rows are written, so that the next, which may read them several times, runs nothing again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
