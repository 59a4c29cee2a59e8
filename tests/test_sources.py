import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from refweave.operators.project import entry_facts
from refweave.sources import bibtex, config, ledger, reflist, works


def test_files_in_either_encoding(spark, tmp_path):
    (tmp_path / "a.bib").write_bytes("@misc{a, title = {Café}}".encode())
    (tmp_path / "b.bib").write_bytes("@misc{b, title = {Café}}".encode("latin-1"))
    got = bibtex.entries_of(bibtex.parse(bibtex.read_files(spark, str(tmp_path)))).collect()
    assert {(r.key, r.fields["title"]) for r in got} == {("a", "Café"), ("b", "Café")}


@pytest.mark.parametrize(
    ("text", "keys", "codes"),
    [
        ("", [], []), ("% only a comment\n", [], []), ("@article{a, title={x}}\n@ARTICLE(b, title = \"y {\"} z\")", ["a", "b"], []),
        ("@article{a, title={x}\n\n@book{b, title={y}}", ["b"], ["malformed_entry"]), ("@string{j = \"Journal\"}\n@article{a, journal = j # { X}, month = jan}", ["a"], []),
        ("@article{a, title={x}, TITLE={y}, title={z}}", ["a"], ["duplicate_field"] * 2), ("@article{a,}\n@article{a,}", ["a"], ["duplicate_key"]), ("@article{nokey", [], ["malformed_entry"]), ("@misc{e}", ["e"], []),
        ("mail@x.org\n@misc{e, note={a\n@ b}}", ["e"], []),
    ],
)
def test_scan(text, keys, codes):
    entries, problems = bibtex.scan_text(text)
    assert [e["key"] for e in entries] == keys and [p["code"] for p in problems] == codes


def test_scan_details():
    (e,), _ = bibtex.scan_text("\n\n@string{j = {Journal}}\n@Article{ key1 ,\n  Title = {A {B} \\} c},\n  journal = j # \" of X\",\n year = 2020 }")
    assert (e["key"], e["entry_type"], e["start_line"]) == ("key1", "article", 4)
    assert e["fields"] == {"title": "A {B} \\} c", "journal": "Journal of X", "year": "2020"} and e["field_order"] == ["Title", "journal", "year"]


def test_facts(spark):
    text = r"""@article{accented2019,
  title   = {Caf\'{e} Culture and {Na\"{i}ve} Bayes: A {S}tudy},
  author  = {P\'{e}rez, Jos\'{e} and Sch{\"o}lkopf, Bernhard and Erd{\H{o}}s, P\'{a}l},
  journal = {Journal of Caf\'{e} Studies}, year = {2019}, volume = {7}, pages = {1234--56}, doi = {10.1000/CAFE.2019}
}
@misc{p, title={Longformer}, eprint={2004.05150}, archivePrefix={arXiv}, year={}, author={}}
@inproceedings{q, editor={A. B.}, date={2016-01}, booktitle={Proc. X}, number={3}, publisher={P}, title={}}"""
    a, p, q = sorted(entry_facts(bibtex.entries_of(bibtex.parse(spark.createDataFrame([("b", text)], "bib_id string, text string")))).collect(), key=lambda r: r.ord)
    assert (a.title, a.year, a.volume, a.doi, a.kind) == ("Café Culture and Naïve Bayes: A Study", 2019, "7", "10.1000/cafe.2019", "journal-article")
    assert [x.family for x in a.authors] == ["Pérez", "Schölkopf", "Erdős"] and (a.pages.start, a.pages.end) == ("1234", "1256")
    assert (p.kind, p.arxiv_id, p.year, p.authors, p.doi) == ("preprint", "2004.05150", None, None, None)
    assert (q.authors[0].family, q.year, q.venue, q.issue, q.title, q.title_key) == ("B.", 2016, "Proc. X", "3", None, None)


@pytest.mark.parametrize("message", [
    {}, [], "x", 5, None, {"title": 5}, {"title": [None, 3, " T "]}, {"author": {"family": "x"}}, {"author": [None, 1, {"given": "only"}]}, {"issued": {"date-parts": "2016"}}, {"issued": {"date-parts": [[], ["x"], [9999], ["2016"]]}},
    {"relation": {"is-retracted-by": "x"}}, {"update-to": {"type": "retraction"}}, {"container-title": {}, "institution": [{"name": " Inst "}]},
])
def test_odd_messages(spark, message):
    r = works.map_works(spark.createDataFrame([(json.dumps(message),)], "message string")).first()
    assert r.retracted is False and r.kind == "other"
    if message == {"title": [None, 3, " T "]}:
        assert r.title == "T"
    if isinstance(message, dict) and "issued" in message:
        assert r.year == (2016 if isinstance(message["issued"]["date-parts"], list) else None)
    if isinstance(message, dict) and "institution" in message:
        assert r.venue == "Inst"


def test_lifecycle(spark):
    cases = [
        ({"updated-by": [{"type": "Partial Retraction"}]}, (True, False, False)), ({"update-to": [{"type": "removal"}]}, (False, True, False)), ({"updated-by": [{"type": "expression-of-concern"}]}, (False, False, True)),
        ({"updated-by": [{"type": "correction"}]}, (False, False, False)), ({"relation": {"is-retracted-by": [{"id": "no doi"}]}}, (True, False, False)),
    ]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(cases)], "i int, message string")
    got = sorted(works.map_works(df).select("i", "retracted", "withdrawn", "expression_of_concern").collect())
    assert [tuple(r)[1:] for r in got] == [c for _, c in cases]


def test_envelopes(spark):
    body = json.dumps({"status": "ok", "message": {"items": [{"DOI": "10.1000/a"}, "x", {"DOI": "10.1000/b"}]}})
    df = spark.createDataFrame([("q", body), ("r", "[]"), ("s", '{"message": 3}')], "id string, body string")
    assert [(r.id, r.pos, json.loads(r.message)["DOI"]) for r in works.search_items(df).orderBy("pos").collect()] == [("q", 0, "10.1000/a"), ("q", 1, "10.1000/b")]
    assert {r.id: r.message is None for r in works.messages_of(df).collect()} == {"q": False, "r": True, "s": True}


def test_ledger(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    rows = [("w", "a", 200, t, 1), ("w", "a", 503, t + day, 2), ("w", "b", 404, t + 40 * day, 3), ("w", "c", 200, t + 40 * day, 4), ("w", "c", 404, t + 40 * day, 5), ("w", "d", 500, t, 6)]
    df = spark.createDataFrame(rows, "namespace string, identifier string, status int, fetched_at timestamp_ntz, n int")
    now = F.lit(t + 41 * day).cast("timestamp_ntz")
    got = {r.identifier: (r.outcome, r.stale) for r in ledger.look_up(df, now, ["namespace", "identifier"], "n").collect()}
    assert got == {"a": ("miss", False), "b": ("not_found", False), "c": ("not_found", False)}
    assert {r.identifier: (r.outcome, r.stale) for r in ledger.look_up(df, now, ["namespace", "identifier"], "n", offline=True).collect()}["a"] == ("found", True)
    ledger.append(df, str(tmp_path / "ledger"))
    ledger.append(df.limit(0), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4


def test_reference_sections():
    text = "We cite references here.\nReferences\nold\n" + "x\n" * 5 + "VI. REFERENCES:\n[1] First ref-\nerence text\n[2] Second [15] one\n[3] Third\n" + "pad " * 60 + "\nAppendix A\ngarbage"
    body, block = reflist.section(text)
    assert "First" not in body and "garbage" not in block
    found = reflist.split(block)
    assert [m for m, _ in found] == ["1", "2", "3"] and found[0][1] == "First reference text" and "[15]" in found[1][1]
    assert reflist.split("Doe, J. (2020). One.\n\nRoe, R. (2021). Two.") == [("1", "Doe, J. (2020). One."), ("2", "Roe, R. (2021). Two.")]
    assert reflist.split("1. Alpha beta\n2) Gamma") == [("1", "Alpha beta"), ("2", "Gamma")]
    assert reflist.split("") == [] and reflist.section("nothing") == ("nothing", "")


def test_entries_from_references(spark):
    raw = [("1", 'A. Vaswani, N. Shazeer, et al., "Attention is all you need," in Advances in Neural Information Processing Systems, vol. 30, no. 2, 2017, pp. 5998-6008. doi: 10.5555/x.1'), ("2", "zzz"), ("a", "arXiv:2004.05150")]
    df = spark.createDataFrame([("p", i, m, r) for i, (m, r) in enumerate(raw)], "bib_id string, ord int, marker string, raw string")
    parsed = reflist.parse_references(df)
    one, two = sorted(reflist.entries_of(parsed).collect(), key=lambda r: r.ord)
    assert (one.key, one.entry_type) == ("ref1", "inproceedings")
    assert one.fields == {"title": "Attention is all you need", "author": "A. Vaswani and N. Shazeer", "booktitle": "Advances in Neural Information Processing Systems", "volume": "30", "number": "2", "pages": "5998--6008", "year": "2017", "doi": "10.5555/x.1"}
    assert (two.key, two.entry_type, two.fields["eprint"]) == ("ref_a", "misc", "2004.05150")
    assert [r.message for r in reflist.problems_of(parsed).collect()] == ["reference [2] could not be parsed"]


def test_settings(tmp_path):
    (tmp_path / "refweave.toml").write_text("[refweave]\nconcurrency = 3\noffline = 'yes'\nttl_days = 'bad'\nunknown = 1\n")
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    got = config.load(inner, {"REFWEAVE_TIMEOUT": "5", "REFWEAVE_CONCURRENCY": "4", "OTHER": "1"}, retries=0)
    assert (got.concurrency, got.offline, got.ttl_days, got.timeout, got.retries) == (4, True, 30, 5.0, 0)
    with pytest.raises(ValueError):
        config.load(inner, {}, concurrency=0)
    (tmp_path / "refweave.toml").write_text("not toml [")
    assert config.load(inner, {}) == config.Settings()
