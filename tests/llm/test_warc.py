import hashlib

import pytest

from refweave.llm import registry, warc
from refweave.llm.shared import table


def brute(rows, least=100):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        ref = first.get(raw) if page is not None else None
        again = ref is not None and ref != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc.archive_path(spark)
    warc.write_archives(df.repartition(3), path)
    got = warc.read_archives(spark, path)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def tricky():
    rows = [(i, f"https://a/{i}", f"<html>{'x' * (i * 37 % 400)} {i} é</html>") for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nWARC-Type: x", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", "y" * 200), (None, "u", "y" * 200), (104, "u", "y" * 200), (99, "u", "y" * 200)]
    rows += [(110 + i, "u", "copy " * 50) for i in range(30)]
    rows += [(200, "u", FAKE), (201, "u", "pre" + FAKE * 3 + "post"), (202, "u", "WARC/1.1\r\n"), (203, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n"), (204, "u", FAKE * 40), (205, "u", FAKE * 40), (206, "u", "\r\n\r\n" * 30 + "WARC/1.1"), (207, "u", "z" * 20_000 + FAKE + "z" * 20_000)]
    return rows


@pytest.mark.parametrize("split", [None, "700", "4096"])
def test_records_survive_splits_and_fakes(spark, split):
    rows = tricky()
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_are_plain_archives(spark):
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame([(1, "u", "héllo"), (2, "u", "x" * 100), (3, "u", "x" * 100)], "page_id long, url string, html string"), path)
    records = 0
    for (_, body) in spark.sparkContext.binaryFiles(path).filter(lambda x: "part-" in x[0]).collect():
        at = 0
        while at < len(body):
            head, _, _ = body[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(head.split(b"Content-Length: ")[1])
            end = at + len(head) + 4 + n
            assert body[end : end + 4] == b"\r\n\r\n"
            at, records = end + 4, records + 1
    assert records == 3


def test_repeated_page_ids(spark):
    long, other = "y" * 200, "z" * 300
    rows = [(1, "u", long), (1, "u", other), (2, "u", long), (3, "u", other), (2, "u", other), (1, "u", long), (4, "u", "short"), (4, "u", "short")]
    got = run(spark, rows)
    assert len(got) == len(rows) and all(n is not None for _, n, *_ in got)
    assert got == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in registry.op2_warc_chains(spark, "/root/testdata/sf0.01").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == brute(rows)
