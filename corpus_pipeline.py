"""A corpus pipeline: from raw documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import lines, packing, similar, substrings, toxicity
from tidewire.llm.session import discard, free_names, materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay.

    Repeated rows get equal scores and stay or go together; a null id stays or goes by its text. An empty table
    gives no rows; all columns stay, whatever their names.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "score")
    return toxicity.score_documents(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of two or more lines that stand in an earlier document, or earlier in the same one, are cut out.

    Earlier is by id; null ids come last. Rows with the same id and text are one document and keep the same lines.
    Null texts stay null, a text may become empty, no row goes; all columns stay.
    """
    return _counted(lines.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard 0.8 of five-word shingles) the document with the smallest id stays.

    Documents are told apart by id and text: another text under an id that goes stays if it is not near, and rows
    with the same id and text count as one. Texts without words are alike. Rows without id stay. An empty table
    gives no rows; all columns stay.
    """
    return similar.drop_similar(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each 200-byte string that stands more than once is cut out, of all places; a cut character is kept whole.

    Repeated rows are copies of each other, so that nothing of their text beyond 199 bytes stays. Null texts stay null, a text
    may become empty, no row goes; all columns stay.
    """
    return _counted(substrings.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as sequences of at most 2048 tokens: a row for each piece of a document, as op3 returns it.

    A null or empty text is a piece of one token; repeated rows are packed as often as they stand.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("best_fit_packing", pack),
]

#: Scores, fingerprints and token ids are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's rows are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
