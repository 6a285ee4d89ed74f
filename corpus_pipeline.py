"""From documents to packed training sequences in five stages; each is one operator of quire.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, jaccard, linededup, packing, toxicity
from quire.llm.common import drop, vocabulary, written
from quire.session import share_code, table


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it is trained on the labelled rows of the original documents.

    Results for odd input: as in quire.llm.toxicity; a null, empty or very long text is
    scored like any other, repeated rows stay or go together, an empty table stays empty
    and all columns stay, whatever they are called. A score that ties with the threshold
    rejects.
    """
    share_code(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to an earlier line, and long ones within two edits of one, go; a document none of whose lines is left goes.

    Results for odd input: as in quire.llm.linededup; null and empty texts stay, rows of
    one id (or none) are told apart by their text, repeated rows stay together (without
    an id one of them), an empty table stays empty and all columns stay. Of lines that
    tie for the earliest place, in rows of one id, that of the smaller text hash stays.
    """
    share_code(spark)
    return linededup.dedup(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Results for odd input: as in quire.llm.jaccard; null, empty and wordless texts and
    rows without id stay, a very long text is taken whole, rows of one id are told apart
    by their text, repeated rows stay or go together, ties for the smallest id go to the
    smaller text hash, an empty table stays empty and all columns stay.
    """
    share_code(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Results for odd input: as in quire.llm.decontam; null, empty and wordless texts stay,
    a very long text is searched whole, rows of one id (or none) are told apart by their
    text, repeated rows stay or go together, an empty table stays empty and all columns
    stay. Terms that tie in rarity change the order of the search, not what it finds.
    """
    share_code(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and packed: one row for each training sequence.

    Results for odd input: as in quire.llm.packing; null and empty texts have no tokens,
    very long texts are cut into sequences, null ids and repeated rows are packed like
    any other, equal lengths go by id, an empty table gives no rows; other columns are
    left out.
    """
    share_code(spark)
    return packing.pack(docs, vocabulary(spark, "byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", clean_toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: No SQL: the first stage trains a network and the last one packs greedily.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = written(made, f"stage-{name}")
        if k:
            drop(docs)  # nothing reads it any more
        docs = made
