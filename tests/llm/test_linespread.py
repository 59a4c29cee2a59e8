from collections import defaultdict

from oracle import spark_rows, sql_rows

from refweave.llm import linespread, registry

SF = "/root/testdata/sf0.01"


def brute(rows, sites):
    where, first = defaultdict(set), {}
    for doc, source, text in rows:
        if text is None or doc is None:
            continue
        for n, line in enumerate(text.split("\n")):
            b = line.strip(" \t\r\x0b\x0c")
            if b:
                where[b].add(source)
                first[b] = min(first.get(b, (doc, n)), (doc, n))
    common = {b for b, s in where.items() if len(s) >= sites}
    out = []
    for doc, source, text in rows:
        if text is None or doc is None:
            out.append((doc, text, 0))
            continue
        parts = text.split("\n")
        kept = [x for n, x in enumerate(parts) if (b := x.strip(" \t\r\x0b\x0c")) not in common or first[b] == (doc, n)]
        out.append((doc, "\n".join(kept), len(parts) - len(kept)))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id long, source string, text string, dropped string, n int")
    return [(r.doc_id, r.text, r.dropped) for r in linespread.drop_boilerplate(df, **kw).collect()]


def key(x):
    return repr(x)


def test_spread_and_keeper(spark):
    rows = [(i, f"s{i % 9}", f"own {i}\n  shared line \t\n\nonly on {i % 4}\nshared line\r") for i in range(40)]
    rows += [(100, None, "shared line"), (101, "s1", None), (None, "s2", "shared line"), (102, "s1", ""), (103, "s3", "\n\n"), (104, "s4", "x" * 50_000 + "\nshared line")]
    for sites in (3, 5, 9, 10, 11):
        assert sorted(run(spark, rows, sites=sites), key=key) == sorted(brute(rows, sites), key=key)


def test_repeated_ids_and_clashing_names(spark):
    shared = "a line of many sites"
    rows = [(i, f"s{i}", f"{shared}\nown {i}") for i in range(1, 8)]
    rows += [(3, "s3", "precious one\nprecious two"), (3, "s9", "precious one\nprecious two"), (1, "s1", f"{shared}\nown 1"), (5, "s5", f"more\n{shared}")]
    df = spark.createDataFrame([(*r, "d", "g", 7, "m") for r in rows], "doc_id long, source string, text string, dropped string, gone string, _gone int, mark string")
    out = linespread.drop_boilerplate(df, count="lost")
    assert out.columns == [*df.columns, "lost"]
    got = sorted((r.doc_id, r.text, r.lost, r.dropped, r.gone, r._gone, r.mark) for r in out.collect())
    want = []
    for i, s, t in rows:
        kept = t if i == 1 else t.replace(f"{shared}\n", "").replace(f"\n{shared}", "")
        want.append((i, kept, int(kept != t), "d", "g", 7, "m"))
    assert got == sorted(want)


def test_hot_line_on_one_site(spark):
    rows = [(i, "hot", "same words\ntail") for i in range(300)] + [(300 + i, f"s{i}", "same words") for i in range(3)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows, 5), key=key)


def test_many_sites(spark):
    rows = [(i, f"s{i}", f"wide\nline {i // 4}\nfour {i // 5}") for i in range(200)]
    for sites in (4, 5, 6):
        assert sorted(run(spark, rows, sites=sites), key=key) == sorted(brute(rows, sites), key=key)


def test_empty(spark):
    assert run(spark, []) == []


def test_sql(spark):
    assert spark_rows(registry.op3_line_spread(spark, SF)) == sql_rows(registry.oracle_sql()["op3_line_spread"], SF)
