import io
import json

from refweave import catalog
from refweave.cli import main
from refweave.operators import resolve, stats
from refweave.operators.project import entry_facts
from refweave.sources import bibtex, reflist


def run(spark, *arguments):
    out = io.StringIO()
    return main([str(a) for a in arguments], spark, out), out.getvalue()


def files(tmp_path):
    bib, reg, tex = tmp_path / "refs.bib", tmp_path / "works.json", tmp_path / "p.tex"
    bib.write_text(catalog.GOLDEN)
    reg.write_text("\n".join(m for _, m in catalog.WORKS))
    tex.write_text(r"\cite{good2016,ghost}")
    return bib, reg, tex


def test_check(spark, tmp_path):
    bib, reg, tex = files(tmp_path)
    code, out = run(spark, "check", bib, "--works", reg, "--tex", tex, "--json", "-", "--stats", "--reference-year", 2020, "--self", "Doe, Jane", "--fail-on", "critical", "--fix", tmp_path / "fixed.bib", "--export-bib", tmp_path / "out.bib")
    assert code == 1 and "doi_not_found" in out and "self-citations  1  (25%)" in out
    doc = json.loads(next(line for line in out.split("\n") if line.startswith("{")))
    assert doc["crosscheck"] == {"uncited": ["wrong2015", "fake2021", "retracted1998"], "undefined": ["ghost"]}
    assert "year = {2016}" in (tmp_path / "fixed.bib").read_text() and "% unverified" in (tmp_path / "out.bib").read_text()
    assert bib.read_text() == catalog.GOLDEN
    code, quiet = run(spark, "check", bib, "--works", reg, "--quiet", "--no-style", "--fail-on", "unresolved")
    assert code == 0 and "case_protection" not in quiet


def test_papers(spark, tmp_path):
    _, reg, _ = files(tmp_path)
    (tmp_path / "paper.txt").write_text("We cite [2], [9] and [12].\n" + catalog.PAPER[catalog.PAPER.index("References") :])
    code, out = run(spark, "check", tmp_path / "paper.txt", "--works", reg, "--papers", "--json", "-", "--no-style")
    doc = json.loads(next(line for line in out.split("\n") if line.startswith("{")))
    assert code == 0 and [e["key"] for e in doc["entries"]] == ["ref1", "ref2", "ref3", "ref4"]
    assert doc["crosscheck"] == {"uncited": ["ref1", "ref3", "ref4"], "undefined": ["ref9", "ref12"]} and len(doc["parse_problems"]) == 1


def test_usage(spark, tmp_path):
    bib, reg, _ = files(tmp_path)
    assert run(spark, "check", bib, "--works", reg, "--fail-on", "sometimes")[0] == 2
    assert run(spark, "check", bib, "--works", reg, "--stats")[0] == 2
    assert run(spark, "check", bib, "--style", "none", "--works", reg)[0] == 2
    assert run(spark, "--version")[0] == 0


def test_cite(spark, tmp_path):
    _, reg, _ = files(tmp_path)
    code, out = run(spark, "cite", "10.1109/CVPR.2016.90", "10.1/none", "--works", reg)
    assert code == 1 and "@inproceedings{he2016residual," in out and "% not found: 10.1/none" in out


def test_recorded_searches(spark):
    bib = "@article{a, title={Deep R & D}, author={Müller, X.}, year={2020}}\n@article{b, title={Other}, year={2020}}"
    facts = entry_facts(bibtex.entries_of(bibtex.parse(spark.createDataFrame([("b", bib)], "bib_id string, text string"))))
    from urllib.parse import urlencode

    asked = {"query.bibliographic": "Deep R & D", "rows": "5", "select": resolve.SELECT, "query.author": "Müller"}
    body = json.dumps({"message": {"items": [{"DOI": "10.1000/no", "title": ["Nothing"]}, {"DOI": "10.1000/yes", "title": ["Deep R and D"], "issued": {"date-parts": [[2020]]}}]}})
    responses = spark.createDataFrame([(urlencode(sorted(asked.items())), body), ("other", body)], "identifier string, body string")
    replies = resolve.recorded_replies(facts, responses)
    got = {r.key: (r.outcome, r.known.doi if r.known else None, r.detail) for r in resolve.best_match(facts, replies).collect()}
    assert got == {"a": ("found", "10.1000/yes", None), "b": ("not_found", None, "no results")}


def test_stats_json(spark):
    facts = entry_facts(bibtex.entries_of(bibtex.parse(spark.createDataFrame([("b", "@misc{a, title={x}}")], "bib_id string, text string"))))
    doc = json.loads(stats.stats_json(stats.summarise(facts, 2020)).first().json)
    assert doc["total"] == 1 and doc["median_year"] is None and doc["venues"] == [] and doc["kinds"] == [{"kind": "other", "count": 1}] and len(doc) == 12


def test_bodies(spark):
    papers = spark.createDataFrame([("p", "cites [1].\nReferences\n[1] x\n[2] y"), ("q", "none")], "bib_id string, text string")
    assert {r.bib_id: r.body.strip() for r in reflist.bodies(papers).collect()} == {"p": "cites [1].", "q": "none"}
