"""One thin query per operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from refweave.llm import crf, lattice, linespread, minhash, mixing, mpegaudio, pieces, secrets, urltrees, warc
from refweave.llm.shared import own_dir, table


def op1_secret_ledger(spark, sf_dir):
    """The even ids are scanned into a new ledger, then all documents: that scan takes what the ledger lacks."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))
    ledger = f"{own_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secrets.scan_into(versions.filter(F.col("path") % 2 == 0), ledger)
    return secrets.summary(secrets.scan_into(versions, ledger))


def op2_warc_chains(spark, sf_dir):
    path = warc.archive_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op4_url_trees(spark, sf_dir):
    model = urltrees.fit(urltrees.seed_urls(spark))
    return urltrees.judge(table(spark, sf_dir, "pages"), model)


def op5_mpeg_audio(spark, sf_dir):
    out = mpegaudio.index(mpegaudio.store(table(spark, sf_dir, "documents")))
    return out.withColumn("n_frames", F.size("frame_offsets"))


def op6_e8_lattice(spark, sf_dir):
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_line_spread(spark, sf_dir):
    out = linespread.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("dropped").cast("long").alias("dropped"), F.col("n_chars").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_line_crf(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = crf.fit(documents, table(spark, sf_dir, "labels"))
    scored = crf.score(documents, model, ["doc_id"])
    return scored.select("doc_id", crf.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_pivotal_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_suffix_pieces(spark, sf_dir):
    """Ids and what they spell; ``round_trip`` holds for every text without a literal space mark."""
    out = pieces.encode(table(spark, sf_dir, "documents"), carry=["doc_id"], verify=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256", "round_trip")


def op8_minmax_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_ledger, op2_warc_chains, op4_url_trees, op5_mpeg_audio, op6_e8_lattice, op3_line_spread, op7_pivotal_mix, op9_suffix_pieces, op8_minmax_minhash, op10_line_crf)}


def oracle_sql() -> dict:
    return {"op3_line_spread": LINE_SPREAD}


LINE_SPREAD = """
WITH parts AS (
  SELECT doc_id, source, n_chars, text, string_split(text, chr(10)) AS p FROM documents
), lines AS (
  SELECT doc_id, source, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS n FROM parts
), bare AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS b FROM lines
), common AS (
  SELECT b, min({'d': doc_id, 'n': n}) AS first FROM bare WHERE b <> '' AND doc_id IS NOT NULL
  GROUP BY b HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 5
), marked AS (
  SELECT x.doc_id, x.line, x.n, (c.b IS NOT NULL AND NOT (c.first.d = x.doc_id AND c.first.n = x.n)) AS gone
  FROM bare x LEFT JOIN common c ON x.b = c.b
), rebuilt AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS dropped,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.dropped, 0) AS dropped,
       CASE WHEN coalesce(r.dropped, 0) > 0 THEN CAST(length(r.kept) AS BIGINT) ELSE d.n_chars END AS n_chars,
       sha256(CASE WHEN coalesce(r.dropped, 0) > 0 THEN r.kept ELSE d.text END) AS text_sha256
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
