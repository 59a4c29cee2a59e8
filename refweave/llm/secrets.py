"""Secret scans with an incremental blob ledger.

Every historical version of a path is addressed by the SHA-256 of its content.
The ledger holds the (blob, rule, rule version) triples that were scanned and
what was found there. Only triples that it lacks are scanned, each blob once
however many paths and versions hold it; findings are then joined to all paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.shared import join_salted, lean, maybe_among, sieve, stash


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and non-overlapping; those with a shorter ``group`` than ``least`` are dropped.

    ``hints``: one of these must occur in the lower-cased text for the pattern to match at all.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hints: tuple[str, ...] = ()


# Fixed patterns and lengths: the three base kinds come first and in this order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, hints=("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, hints=("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, hints=("private key",)),
)
RULES = BASE + MORE

FOUND = "array<struct<rule:int,kind:string,version:int,start:int,end:int>>"


def find(text: str, rules: tuple[Rule, ...] = RULES, compiled: list | None = None) -> list[tuple[int, str, int, int, int]]:
    """(rule number, kind, version, start, end) of all matches by start, then rule; in code points, end exclusive."""
    compiled = compiled or [re.compile(r.pattern, re.ASCII) for r in rules]
    low = text.lower()
    out = []
    for k, (rule, pattern) in enumerate(zip(rules, compiled)):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((k, rule.kind, rule.version, m.start(), m.end()))
    out.sort(key=lambda x: (x[3], x[0]))
    return out


def merged() -> Column:
    """All that several scans of a blob found, each finding once: its number among the rules of a scan is not part of it."""
    every = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct(F.lit(0).alias("rule"), x["kind"].alias("kind"), x["version"].alias("version"), x["start"].alias("start"), x["end"].alias("end")))
    return F.array_distinct(every)


@dataclass
class Scan:
    """``blobs``: the blobs scanned now with what was found; ``paths``: all paths with the findings of their blob."""

    blobs: DataFrame
    paths: DataFrame


def address(versions: DataFrame) -> DataFrame:
    """(path, version, blob, content): null content is an empty blob."""
    content = F.coalesce(F.col("content").cast("string"), F.lit(""))
    return versions.select("path", "version", F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("content"))


def unseen_blobs(addressed: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """What a scan adds to ``ledger``: (blob, rules, found) of the blobs of ``addressed`` with rules that it lacks for them."""
    wanted = [(r.kind, r.version) for r in rules]
    texts = addressed.select("blob", "content")
    none = F.lit(None).cast("array<struct<kind:string,version:int>>")
    old = None
    if ledger is not None:
        old = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        every = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in wanted])
        complete = old.filter(F.size(F.array_except(every, "done")) == 0).select("blob")
        unseen = stash(addressed.select("blob").distinct().join(complete, "blob", "left_anti").select(F.xxhash64("blob").alias("id")), "unseen")
        # Contents that have been scanned in full stay where they are; few others pass the sieve with the unseen ones.
        texts = texts.filter(maybe_among(sieve(unseen), F.xxhash64("blob")))
    # One row per blob and task reaches the shuffle, so a blob with many copies costs no more than one.
    blobs = texts.dropDuplicates(["blob"])
    blobs = blobs.withColumn("done", none) if old is None else blobs.join(old, "blob", "left")

    def run(batches):
        compiled = {r: re.compile(r.pattern, re.ASCII) for r in rules}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32())]))
        found = pa.list_(pa.struct([("rule", pa.int32()), ("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            scanned, results = [], []
            for text, done in zip(batch.column("content"), batch.column("done")):
                seen = {(d["kind"], d["version"]) for d in done.as_py() or ()}
                todo = tuple(r for r in rules if (r.kind, r.version) not in seen)
                scanned.append([{"kind": r.kind, "version": r.version} for r in todo])
                hits = find(text.as_py(), todo, [compiled[r] for r in todo]) if todo else []
                results.append([{"rule": wanted.index((k, v)), "kind": k, "version": v, "start": s, "end": e} for _, k, v, s, e in hits])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(scanned, kind), pa.array(results, found)], ["blob", "rules", "found"])

    return lean(blobs).mapInArrow(run, LEDGER).filter(F.size("rules") > 0)


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scan the unseen part of ``versions`` (path, version, content) and place all findings.

    ``ledger`` has (blob binary, rules array<struct<kind,version>>, found) as an
    earlier ``Scan.blobs`` had them; several rows per blob are several scans, and
    a scan that is recorded twice, as by a retry, counts once. Repeated rows, null
    paths and null versions pass through; extra columns are ignored. An empty
    table gives empty frames.
    """
    addressed = address(versions)
    fresh = stash(unseen_blobs(addressed, ledger, rules), "scan")
    every = fresh.select("blob", "found") if ledger is None else fresh.select("blob", "found").union(ledger.select("blob", "found"))
    return Scan(fresh, place(addressed, every.groupBy("blob").agg(merged().alias("found")), rules))


def place(addressed: DataFrame, results: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, found): ``results`` (blob, found), but for rules or versions that are not asked for, at all paths.

    Only paths whose blob may have findings are shuffled, and a blob of very
    many paths is dealt over many tasks.
    """
    index = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (f"{r.kind}/{r.version}", k)])
    at = lambda x: F.element_at(index, F.concat(x["kind"], F.lit("/"), x["version"].cast("string")))
    asked = F.filter("found", lambda x: at(x).isNotNull())
    ordered = F.array_sort(F.transform(asked, lambda x: F.struct(x["start"].alias("start"), at(x).alias("rule"), x["end"].alias("end"), x["kind"].alias("kind"))))
    hits = stash(results.select("blob", ordered.alias("found")).filter(F.size("found") > 0), "hits")
    empty = F.array().cast(hits.schema["found"].dataType)
    bits = sieve(hits.select(F.xxhash64("blob").alias("id")))
    paths = addressed.select("path", "version", "blob").withColumn("maybe", maybe_among(bits, F.xxhash64("blob")))
    some = stash(paths.filter("maybe").drop("maybe"), "paths")
    often = some.groupBy("blob").agg(F.count(F.lit(1)).alias("paths"))
    facts = often.join(hits, "blob", "left").select("blob", "paths", F.coalesce("found", empty).alias("found"))
    found = join_salted(some, facts, ["blob"], "paths", ["path", "version"], some.count()).select("path", "version", "blob", "found")
    return paths.filter("not maybe").select("path", "version", "blob", empty.alias("found")).union(found)


LEDGER = f"blob binary, rules array<struct<kind:string,version:int>>, found {FOUND}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier scans have recorded under ``path``; None before the first."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if there else None


def scan_into(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger under ``path`` lacks, record it there, and return all paths with all findings.

    The scan is written first; the findings are then read from the ledger, so
    no blob is scanned twice. Scans that run at once may both record a blob.
    """
    spark = versions.sparkSession
    addressed = address(versions)
    unseen_blobs(addressed, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    results = read_ledger(spark, path).groupBy("blob").agg(merged().alias("found"))
    return place(addressed, results, rules)


def summary(paths: DataFrame) -> DataFrame:
    """Counts and digests of ``Scan.paths``, a row for each of its rows: doc_id is the path.

    Null and repeated paths keep their rows. A row without findings has counts of
    0, empty spans and the digest of the empty string. Other columns are ignored;
    an empty table gives an empty frame.
    """

    def spans(x):
        return F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("found", lambda f: f["kind"].isin(*[r.kind for r in BASE]))
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long")
    return paths.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spans(base), 256).alias("base_sha256"),
        spans(F.col("found")).alias("spans"),
        F.lower(F.hex("blob")).alias("blob_sha256"),
    )
