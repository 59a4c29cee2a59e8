"""WARC archives: written by Spark's text writer, read back in splits, with boundary-chain verification.

A payload may hold the very bytes that open a record. So the reader only takes
places where they occur as candidates. The task that reads a split gives each
candidate's successor, the place where its declared length ends, and follows
such links to the end of the split. Over the splits of a file, pointers are then
doubled from the file's start until nothing new is reached. Candidates that no
chain from the start reaches are bytes of a payload and are dropped.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refweave.llm import linking
from refweave.llm.shared import maybe_among, own_dir, sieve, stash

MAGIC = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
STRETCH = 1 << 20  # bytes of a file that are looked at together where records lie across splits
LEAST = 100  # bytes of payload from which on equal payloads are written once


def _digested(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """A record per row of ``pages`` (page_id, url, html) in the WARC files of folder ``path``.

    Null html is empty. Of equal payloads of ``least`` bytes or more, the rows
    of the smallest page_id are responses and the others revisits of it. Rows
    with a null page_id are responses. Other columns are ignored; an empty table
    writes no record.
    """
    rows = _digested(pages).withColumn("digest", F.sha2("html", 256))
    keyed = rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    heads = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = stash(keyed.join(heads, "digest").filter("page_id <> first").distinct(), "revisits")
    # Only rows that may be revisits go through the join; the rest need no shuffle.
    marked = rows.withColumn("maybe", maybe_among(sieve(again, "page_id"), F.col("page_id")))
    out = marked.filter("not maybe").withColumn("first", F.lit(None).cast("long")).union(marked.filter("maybe").join(again, ["page_id", "digest"], "left").select(*rows.columns, "maybe", "first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("first").isNotNull()
    body = F.when(revisit, "").otherwise(F.concat(F.lit(HTTP), F.col("html")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    # The writer's line end is the last byte of a record.
    out.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)\r?$")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _opened(row: bytes) -> tuple[dict, int, int] | None:
    """(fields, bytes of the head, declared bytes) of what follows a magic, or None if it is no head."""
    stop = row.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(row, 0, stop)}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    return fields, stop + 4, int(length)


def _payload(block: bytes) -> bytes:
    stop = block.find(b"\r\n\r\n")
    return block[stop + 4 :] if stop >= 0 else b""


def _page(value: bytes | None) -> int | None:
    m = _PAGE.fullmatch(value or b"")
    return int(m[1]) if m else None


_SCAN = (
    "file string, block long, row long, pos long, used long, candidate boolean, succ long, exit long, whole boolean, "
    "page_id long, record_type string, refers_to long, declared string, payload_bytes long, payload_digest string"
)


def _candidates(lines: DataFrame) -> DataFrame:
    """A row per magic of each split, at offsets from the split's first row; positions are of the magic's first byte."""
    magic = len(MAGIC)

    def split(rows):
        """Follow links within the split from its end: exit is where a chain leaves it, or -1 where it breaks."""
        place = {r["pos"]: r for r in rows if r["candidate"]}
        end = rows[-1]["pos"] + rows[-1]["used"]
        for r in reversed(rows):
            if r["candidate"]:
                nxt = place.get(r["succ"])
                r["exit"] = nxt["exit"] if nxt else (r["succ"] if r["succ"] >= end else -1)
        return pd.DataFrame(rows)

    def run(batches):
        now, rows, at = None, [], 0
        for batch in batches:
            for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
                if (file, block) != now:
                    if rows:
                        yield split(rows)
                    # What comes before the first magic of a file, normally nothing, is a row without one.
                    now, rows, at = (file, block), [], 0 if block == 0 else -magic
                raw = value.as_py()
                row = dict(file=file, block=block, row=len(rows), pos=at, used=len(raw) + magic, candidate=False, succ=-1, exit=-1, whole=False, page_id=None, record_type=None, refers_to=None, declared=None, payload_bytes=None, payload_digest=None)
                if block == 0 and not rows:
                    row["pos"], row["used"] = -1, len(raw)
                    at = len(raw)
                    rows.append(row)
                    continue
                head = _opened(raw)
                if head:
                    fields, start, length = head
                    whole = start + length + 4 == len(raw) and raw.endswith(b"\r\n\r\n")
                    row |= dict(candidate=True, succ=at + magic + start + length + 4, whole=whole, page_id=_page(fields.get(b"warc-record-id")), record_type=fields[b"warc-type"].decode("latin-1"), refers_to=_page(fields.get(b"warc-refers-to")), declared=fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:"))
                    if whole:
                        body = _payload(raw[start : start + length])
                        row |= dict(payload_bytes=len(body), payload_digest=hashlib.sha256(body).hexdigest())
                at += len(raw) + magic
                rows.append(row)
        if rows:
            yield split(rows)

    def frames(batches):
        for f in run(batches):
            f = f.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})
            yield pa.RecordBatch.from_pandas(f, schema=_schema, preserve_index=False)

    _schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in _SCAN.split(", "))])
    return lines.mapInArrow(frames, _SCAN)


def scan(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the WARC files of ``path``.

    Digests and sizes are taken from the bytes read; a revisit has those of the
    response that it refers to, and null size if none there has its digest.
    Pages that repeat a page_id have a row each, by their own payload.
    """
    rows = stash(_candidates(scan(spark, path)), "candidates")
    # Where each split's first row lies in its file: the bytes that all splits before it consumed.
    used = rows.groupBy("file", "block").agg(F.sum("used").alias("used"))
    base = used.select("file", "block", (F.sum("used").over(Window.partitionBy("file").orderBy("block")) - F.col("used")).alias("before"))
    shift = F.when(F.col("block") == 0, 0).otherwise(F.col("before") + len(MAGIC))
    # A split after the first begins behind a magic that the split before it has consumed.
    lift = lambda c: F.when(F.col(c) >= F.lit(-len(MAGIC)), F.col(c) + F.col("shift")).otherwise(F.col(c))
    placed = rows.join(base.withColumn("shift", shift).drop("before"), ["file", "block"])
    placed = placed.withColumn("gpos", F.when((F.col("block") == 0) & (F.col("row") == 0), -1).otherwise(lift("pos")))
    placed = stash(placed.withColumn("gsucc", F.when(F.col("candidate"), lift("succ")).otherwise(-1)).withColumn("gexit", F.when(F.col("exit") >= 0, lift("exit")).otherwise(-1)), "placed")
    found = placed.filter("candidate")
    ends = found.select("file", F.col("gexit").alias("at")).filter("at >= 0").union(found.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jump = stash(found.join(ends, (found["file"] == ends["file"]) & (found["gpos"] == ends["at"]), "left_semi").select("file", F.col("gpos").alias("at"), F.col("gexit").alias("to")), "jumps")
    places = jump.select("file", "at")
    reached = stash(jump.filter("at = 0").select("file", "at"), "reached")
    n = reached.count()
    while True:
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        grown = stash(reached.union(more.join(places, ["file", "at"], "left_semi")).distinct(), "reached")
        m = grown.count()
        reached = grown
        if m == n:
            break
        n = m
        onward = jump.select("file", "at", F.col("to").alias("via")).join(jump.select("file", F.col("at").alias("via"), "to"), ["file", "via"])
        jump = stash(onward.select("file", "at", "to"), "jumps")
    entry = reached.withColumnRenamed("at", "gpos").withColumn("entry", F.lit(True))
    marked = found.join(entry, ["file", "gpos"], "left").select("file", "block", "gpos", "gsucc", F.coalesce("entry", F.lit(False)).alias("entry"))

    def walk(batches):
        for g in linking.groups(batches, ["file", "block"]):
            step = dict(zip(g["gpos"], g["gsucc"]))
            starts = g["gpos"][g["entry"].astype(bool)]
            chain, at = [], starts[0] if len(starts) else None
            while at in step:
                chain.append(at)
                at = step.pop(at)
            if chain:
                yield pd.DataFrame({"file": g["file"][0], "block": g["block"][0], "gpos": chain})

    chains = marked.repartition("file", "block").sortWithinPartitions("file", "block", "gpos").mapInPandas(walk, "file string, block long, gpos long")
    real = stash(found.join(chains, ["file", "block", "gpos"]), "records")
    whole = real.filter("whole").select("page_id", "record_type", "refers_to", "declared", "payload_bytes", "payload_digest")
    split = real.filter("not whole").select("file", "gpos", "gsucc", "page_id", "record_type", "refers_to", "declared")
    if not split.isEmpty():
        whole = whole.union(_rejoined(spark, path, placed, split))
    # A page_id may have several responses: a revisit means the one with the digest that it declares.
    answers = whole.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared"), F.col("payload_bytes").alias("n")).dropDuplicates(["refers_to", "declared"])
    revisits = whole.filter("record_type = 'revisit'").join(answers, ["refers_to", "declared"], "left")
    return whole.filter("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").union(
        revisits.select("page_id", "n", "declared", "record_type", "refers_to")
    )


def _rejoined(spark, path, placed, split) -> DataFrame:
    """Records whose payload holds the magic: their rows, from any split, end to end again."""
    # Which record a row lies in: both are listed by the stretches of the file that they touch, so no task sees a whole file.
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    spans = split.select("file", F.col("gpos").alias("owner"), F.col("gsucc").alias("stop"), F.explode(F.sequence(stretch("gpos"), F.floor((F.col("gsucc") - 1) / STRETCH))).alias("stretch"))
    rows = placed.filter("gpos >= 0").select("file", "block", "row", "gpos", stretch("gpos").alias("stretch"))
    wanted = rows.join(spans, ["file", "stretch"]).filter("gpos >= owner and gpos < stop").select("file", "block", "row", "gpos", "owner")

    def number(batches):
        now, k = None, 0
        for batch in batches:
            rows = []
            for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                now, k = key, (k + 1 if key == now else 0)
                rows.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(rows, pa.int64()), batch.column("value")], ["file", "block", "row", "value"])

    raw = scan(spark, path).mapInArrow(number, "file string, block long, row long, value binary").join(wanted, ["file", "block", "row"])

    def glue(batches):
        for g in linking.groups(batches, ["file", "owner"]):
            whole = MAGIC.encode().join(g["value"])
            head = _opened(whole)
            body = _payload(whole[head[1] : head[1] + head[2]])
            yield pd.DataFrame({"file": [g["file"][0]], "gpos": [g["owner"][0]], "payload_bytes": [len(body)], "payload_digest": [hashlib.sha256(body).hexdigest()]})

    glued = raw.repartition("file", "owner").sortWithinPartitions("file", "owner", "gpos").mapInPandas(glue, "file string, gpos long, payload_bytes long, payload_digest string")
    return split.join(glued, ["file", "gpos"]).select("page_id", "record_type", "refers_to", "declared", "payload_bytes", "payload_digest")


def archive_path(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
