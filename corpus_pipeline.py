"""From raw documents to token ids in five stages, each by an operator of ``refweave.llm``.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns a DataFrame, which ``run`` writes as Parquet and reads again. All but
the last return the columns of ``documents``, with any others that these have and
whatever the names of those. Equal rows are judged alike by all stages but
near-dedup, which keeps one of them, and mixing, which shares copies among them.
Texts of any length are read whole, and empty tables give empty frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import crf, linespread, minhash, mixing, pieces
from refweave.llm.shared import scratch, spare, stash, table

GOOD = 0.3  # documents with a lower score go
NEAR = 80  # percent of shared shingles (Jaccard) from which documents are near-duplicates; op8's own contract says 85


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines the random field judges good; trained on the labels of ``sf_dir``.

    Null texts score as empty ones; a score of just ``GOOD`` stays. Null and
    repeated doc_ids are judged by their texts. Without labels every score is
    0.5 and all documents stay.
    """
    model = crf.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = spare(docs, "score")
    return crf.score(docs, model, name=score).filter(F.col(score) >= GOOD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sites share out of all documents but one; a document that loses every word goes.

    Null and empty texts and rows with a null doc_id stay as they are. A line
    stays in the document of the smallest doc_id; of a doc_id with several texts,
    in that of the smallest hash; rows that repeat both keep it alike.
    """
    (dropped,) = spare(docs, "dropped")
    out = linespread.drop_boilerplate(docs, count=dropped)
    emptied = (F.col(dropped) > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.filter(~F.coalesce(emptied, F.lit(False))).drop(dropped)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near-duplicates.

    Null and blank texts and rows with a null doc_id are in no group and stay.
    Rows of one doc_id with unlike texts are judged apart; of rows that repeat
    doc_id and text, one stays.
    """
    return minhash.deduplicate(docs, percent=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words come to its target.

    Null and blank texts have no words and go; a null source is a source of its
    own. Null and repeated doc_ids are mixed like others; rows that repeat
    doc_id, text and source differ by one copy at most.
    """
    return mixing.take(docs, stash(mixing.mix(docs), "mix"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, decoded_sha256, round_trip, n_ids) of every row: token ids, with a digest of what they decode to.

    Null texts have null ids, a null digest and -1 ids; empty texts have none.
    Repeated rows keep their rows. Other columns are left out.
    """
    out = pieces.encode(docs, carry=["doc_id", "lang", "source"], verify=True)
    return out.withColumn("n_ids", F.coalesce(F.size("ids"), F.lit(-1)).cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

# Learned scores and random rounding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. What a stage wrote on its way, and its input, goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as kept:
        for name, stage in STAGES:
            with scratch(spark) as made:
                docs = stash(stage(spark, docs, sf_dir), name)
                made.pop()
        kept.pop()
    return docs
