"""Queries over general tables and the SQL that each is held against.

Queries over tables run the operators on the projections of ``plans.tables``.
Golden queries run them on literals; their SQL states the expected values, so
they test against published expectations and not against another computation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from refweave.functions import identifiers, latex, names, scalars, similarity
from refweave.functions.keys import suggest_key, unique_keys
from refweave.operators import bibwide, export, fixes, rules, stats, verdict
from refweave.operators.project import entry_facts
from refweave.operators.resolve import best_match, candidates, resolve
from refweave.plans import tables as T
from refweave.plans.check import check, cite
from refweave.sources import bibtex, ledger, reflist, works

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]::VARCHAR[]"
    return "'" + str(x).replace("'", "''") + "'"


def golden(name: str, schema: str, rows: list[tuple], compute: Callable, columns: str, expected: list[tuple]) -> None:
    """Register a query over literal rows whose SQL is the list of expected ones. ``columns``: name and SQL type of each."""
    pairs = [c.split(":") for c in columns.split()]

    def run(spark, sf_dir):
        return compute(spark.createDataFrame(rows, schema))

    QUERIES[name] = run
    values = ",\n  ".join("(" + ", ".join(map(literal, r)) + ")" for r in expected)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in pairs)
    SQL[name] = f"SELECT {casts} FROM (VALUES\n  {values}) AS v({', '.join(n for n, _ in pairs)})"


# -- shared SQL --------------------------------------------------------------------

E = """
e AS (SELECT source AS bib_id, CAST(doc_id AS INTEGER) AS ord, 'd' || doc_id AS key, text AS title,
  CASE WHEN doc_id % 5 <> 0 THEN '10.5555/doc.' || doc_id END AS doi,
  1990 + doc_id % 35 + (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS year,
  (CASE WHEN doc_id % 9 = 0 THEN 'J. of ' ELSE 'Journal of ' END) || lang AS venue, lang,
  CAST(doc_id % 40 AS VARCHAR) AS volume, (n_chars % 900) AS p0, (n_chars % 900) + doc_id % 50 AS p1,
  CASE WHEN doc_id % 17 = 0 THEN '2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS arxiv, doc_id
  FROM documents),
w AS (SELECT '10.5555/doc.' || d.doc_id AS doi, 1990 + d.doc_id % 35 AS year,
  CASE WHEN d.doc_id % 23 = 0 THEN 'Annals of Botany ' || d.lang ELSE 'Journal of ' || d.lang END AS venue,
  CAST(d.doc_id % 40 + (CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END) AS VARCHAR) AS volume,
  (d.n_chars % 900) AS p0, (d.n_chars % 900) + d.doc_id % 50 + (CASE WHEN d.doc_id % 19 = 0 THEN 1 ELSE 0 END) AS p1,
  l.toxic = 1 AS retracted, l.quality = 0 AS concern,
  CASE WHEN d.doc_id % 17 = 0 THEN '10.5555/doc.' || (d.doc_id + 1) END AS published
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT e.*, w.doi AS wdoi, w.year AS wyear, w.venue AS wvenue, w.volume AS wvolume, w.p0 AS w0, w.p1 AS w1, w.retracted, w.concern, w.published,
  CASE WHEN w.doi IS NULL THEN 'not_found' ELSE 'found' END AS outcome FROM e LEFT JOIN w ON e.doi = w.doi),
drift AS (
  SELECT bib_id, ord, 'year_mismatch' AS code, 'warn' AS severity, CAST(year AS VARCHAR) AS local, CAST(wyear AS VARCHAR) AS authoritative FROM r WHERE year <> wyear
  UNION ALL SELECT bib_id, ord, 'volume_mismatch', 'warn', volume, wvolume FROM r WHERE volume <> wvolume
  UNION ALL SELECT bib_id, ord, 'pages_mismatch', 'warn', p0 || '-' || p1, w0 || '-' || w1 FROM r WHERE p0 || '-' || p1 <> w0 || '-' || w1
  UNION ALL SELECT bib_id, ord, 'venue_mismatch', CASE WHEN doc_id % 9 = 0 THEN 'info' ELSE 'warn' END, venue, wvenue FROM r WHERE wdoi IS NOT NULL AND (doc_id % 23 = 0 OR doc_id % 9 = 0)),
found AS (
  SELECT bib_id, ord, 'doi_not_found' AS code, 'critical' AS severity FROM r WHERE wdoi IS NULL AND doi IS NOT NULL
  UNION ALL SELECT bib_id, ord, 'not_found_by_title', 'warn' FROM r WHERE doi IS NULL
  UNION ALL SELECT bib_id, ord, 'retracted', 'critical' FROM r WHERE retracted
  UNION ALL SELECT bib_id, ord, 'expression_of_concern', 'critical' FROM r WHERE concern
  UNION ALL SELECT bib_id, ord, 'preprint_superseded', 'warn' FROM r WHERE arxiv IS NOT NULL AND published IS NOT NULL AND doi <> published
  UNION ALL SELECT bib_id, ord, 'missing_required_field', 'warn' FROM r WHERE regexp_matches(title, '^\\s*$')
  UNION ALL SELECT bib_id, ord, 'missing_required_field', 'warn' FROM r WHERE doc_id % 6 = 0
  UNION ALL SELECT bib_id, ord, code, severity FROM drift),
v AS (SELECT r.bib_id, r.ord, r.key, CASE WHEN bool_or(f.severity = 'critical') THEN 'critical' WHEN r.outcome <> 'found' THEN 'unresolved'
  WHEN bool_or(f.severity = 'warn') THEN 'warn' ELSE 'ok' END AS status FROM r LEFT JOIN found f ON r.bib_id = f.bib_id AND r.ord = f.ord GROUP BY r.bib_id, r.ord, r.key, r.outcome)
"""


def _resolved(spark, sf_dir):
    w = T.works(spark, sf_dir)
    return resolve(entry_facts(T.entries(spark, sf_dir)), w, T.no_replies(spark, w))


def _codes(found, *codes):
    """Findings of these codes; only the rules that give them are run."""
    only = tuple({rules.RULE_OF[c] for c in codes})
    return rules.entry_problems(found, only=only).filter(F.col("code").isin(*codes)).select("bib_id", "ord", "code", "severity", "local", "authoritative")


def _findings(spark, sf_dir, *codes):
    return _codes(_resolved(spark, sf_dir), *codes)


def _reports(spark, sf_dir):
    return verdict.row_reports(rules.with_findings(_resolved(spark, sf_dir)))


@query(f"WITH {E} SELECT bib_id, ord, outcome FROM r WHERE doi IS NOT NULL")
def resolve_by_doi(spark, sf_dir):
    return _resolved(spark, sf_dir).filter("doi is not null").select("bib_id", "ord", "outcome")


@query(f"WITH {E} SELECT bib_id, ord, code, severity FROM found WHERE code IN ('doi_not_found', 'not_found_by_title')")
def existence_findings(spark, sf_dir):
    return _findings(spark, sf_dir, "doi_not_found", "not_found_by_title").drop("local", "authoritative")


@query(f"WITH {E} SELECT bib_id, ord, code, severity FROM found WHERE code IN ('retracted', 'expression_of_concern')")
def lifecycle_findings(spark, sf_dir):
    return _findings(spark, sf_dir, "retracted", "withdrawn", "expression_of_concern").drop("local", "authoritative")


@query(f"WITH {E} SELECT * FROM drift WHERE code = 'year_mismatch'")
def drift_year(spark, sf_dir):
    return _findings(spark, sf_dir, "year_mismatch")


@query(f"WITH {E} SELECT * FROM drift WHERE code = 'volume_mismatch'")
def drift_volume(spark, sf_dir):
    return _findings(spark, sf_dir, "volume_mismatch")


@query(f"WITH {E} SELECT * FROM drift WHERE code = 'pages_mismatch'")
def drift_pages(spark, sf_dir):
    return _findings(spark, sf_dir, "pages_mismatch")


@query(f"WITH {E} SELECT * FROM drift WHERE code = 'venue_mismatch'")
def venue_drift_severity(spark, sf_dir):
    return _findings(spark, sf_dir, "venue_mismatch")


@query(f"WITH {E} SELECT r.bib_id, r.ord, r.arxiv AS local, r.published AS authoritative FROM r JOIN found f ON r.bib_id = f.bib_id AND r.ord = f.ord WHERE f.code = 'preprint_superseded'")
def preprint_superseded(spark, sf_dir):
    return _findings(spark, sf_dir, "preprint_superseded").select("bib_id", "ord", "local", "authoritative")


@query(f"WITH {E} SELECT bib_id, ord, key, status FROM v")
def entry_verdict(spark, sf_dir):
    return _reports(spark, sf_dir).select("bib_id", "ord", "key", "status")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("ok", "warn", "critical", "unresolved", "network_error"))


@query(f"WITH {E} SELECT v.bib_id, {_COUNTS}, count(*) FILTER (WHERE r.outcome = 'found') AS verified FROM v JOIN r ON v.bib_id = r.bib_id AND v.ord = r.ord GROUP BY v.bib_id")
def status_summary(spark, sf_dir):
    return verdict.summary(_reports(spark, sf_dir)).drop("worst_status")


@query(f"""WITH {E} SELECT bib_id, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'network_error') THEN 'network_error'
  WHEN bool_or(status = 'unresolved') THEN 'unresolved' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ok' END AS worst_status FROM v GROUP BY bib_id""")
def worst_status(spark, sf_dir):
    return verdict.summary(_reports(spark, sf_dir)).select("bib_id", "worst_status")


@query(f"WITH {E} SELECT bib_id, bool_or(status IN ('critical', 'warn', 'network_error')) AS fails FROM v GROUP BY bib_id")
def fail_on(spark, sf_dir):
    return verdict.fails(_reports(spark, sf_dir), "warn,error")


@query(f"""WITH {E}, failed AS (SELECT CAST(user_id AS INTEGER) AS id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id) WHERE kind = 'error')
  SELECT v.bib_id, v.ord, CASE WHEN f.id IS NOT NULL THEN 'network_error' ELSE v.status END AS status FROM v LEFT JOIN failed f ON v.ord % 150 = f.id""")
def network_failures(spark, sf_dir):
    """Entries whose identifier last got a server failure: nothing else about them is trusted."""
    last = T.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind")).filter("kind = 'error'")
    entries = T.entries(spark, sf_dir)
    failed = entries.join(last, F.col("ord") % 150 == F.col("user_id"), "left_semi").select("bib_id", "ord", F.lit("network_error").alias("outcome"), F.lit("503").alias("detail"))
    w = T.works(spark, sf_dir)
    found = resolve(entry_facts(entries), w, T.no_replies(spark, w))
    lost = found.join(failed.select("bib_id", "ord", F.col("outcome").alias("o")), ["bib_id", "ord"], "left").select(*[c for c in found.columns if c != "outcome"], F.coalesce("o", "outcome").alias("outcome"))
    return verdict.row_reports(rules.with_findings(lost)).select("bib_id", "ord", "status")


TITLE_KEY = (
    "array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace({x}, '&', ' and '), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'))), "
    "'[^a-z0-9_]+', ' ', 'g')), ' +'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
)


@query(f"SELECT doc_id, {TITLE_KEY.format(x='text')} AS title_key FROM documents")
def title_key(spark, sf_dir):
    """Whole texts as titles."""
    return T.table(spark, sf_dir, "documents").select("doc_id", latex.title_keys("text").alias("title_key"))


D = f"""
d0 AS (SELECT source AS bib_id, CAST(doc_id AS INTEGER) AS ord, 'd' || doc_id AS key, text AS title,
  1990 + n_chars % 35 AS year, CASE WHEN doc_id % 5 <> 0 THEN '10.5555/' || lower(source) || '.' || (length(text) % 97) END AS doi FROM documents),
d AS (SELECT *, {TITLE_KEY.format(x='title')} AS tk FROM d0),
sig AS (SELECT bib_id, ord, key, 0 AS pos, 'doi:' || doi AS s FROM d WHERE doi IS NOT NULL
  UNION ALL SELECT bib_id, ord, key, 2, 'title:' || tk || '|' || year FROM d WHERE tk <> ''),
grp AS (SELECT bib_id, s, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS members, count(*) AS n FROM sig GROUP BY bib_id, s HAVING count(*) > 1),
sets AS (SELECT DISTINCT bib_id, members FROM grp)
"""


@query(f"""WITH {D}, m AS (SELECT bib_id, members, CAST(unnest(string_split(members, ',')) AS INTEGER) AS ord FROM sets)
  SELECT a.bib_id, a.ord, string_agg('d' || b.ord, ', ' ORDER BY b.ord) AS others FROM m a JOIN m b ON a.bib_id = b.bib_id AND a.members = b.members AND a.ord <> b.ord GROUP BY a.bib_id, a.members, a.ord""")
def duplicate_works(spark, sf_dir):
    found = bibwide.duplicates(entry_facts(T.copies(spark, sf_dir)))
    return found.select("bib_id", "ord", F.col("authoritative").alias("others"))


@query(f"WITH {D} SELECT bib_id, count(*) AS n_sets, CAST(sum(length(members) - length(replace(members, ',', '')) + 1) AS BIGINT) AS n_members FROM sets GROUP BY bib_id")
def duplicate_groups(spark, sf_dir):
    groups = bibwide.duplicate_groups(entry_facts(T.copies(spark, sf_dir)))
    return groups.groupBy("bib_id").agg(F.count(F.lit(1)).alias("n_sets"), F.sum(F.size("members")).alias("n_members"))


C = "c AS (SELECT DISTINCT 'd' || ((conv_id * 31 + turn * 7) % ((SELECT count(*) FROM documents) + 20)) AS key FROM conversations)"


def _one_bibliography(spark, sf_dir):
    return T.entries(spark, sf_dir).withColumn("bib_id", F.lit("all"))


@query(f"WITH {C} SELECT CAST(doc_id AS INTEGER) AS ord, 'd' || doc_id AS key FROM documents WHERE 'd' || doc_id NOT IN (SELECT key FROM c)")
def uncited_entries(spark, sf_dir):
    return bibwide.uncited(_one_bibliography(spark, sf_dir), T.citations(spark, sf_dir)).select("ord", "key")


@query(f"WITH {C} SELECT key FROM c WHERE key NOT IN (SELECT 'd' || doc_id FROM documents)")
def undefined_citations(spark, sf_dir):
    return bibwide.undefined(_one_bibliography(spark, sf_dir), T.citations(spark, sf_dir)).select("key")


@query("""WITH a AS (SELECT p_brand AS bib_id, CAST(p_partkey AS INTEGER) AS ord, split_part(p_name, ' ', 2) AS family, left(split_part(p_name, ' ', 1), 1) AS i,
    CASE WHEN p_partkey % 3 = 0 OR length(split_part(p_name, ' ', 1)) = 1 THEN 'initials' ELSE 'full' END AS form FROM part),
  f AS (SELECT bib_id, family, i, form, count(*) AS n, min(ord) AS first FROM a GROUP BY ALL),
  m AS (SELECT bib_id, family, i, arg_min(form, (n, first)) AS form FROM f GROUP BY bib_id, family, i HAVING count(*) > 1)
  SELECT DISTINCT a.bib_id, a.ord, 'author ''' || a.family || ''' is given as ' || (CASE WHEN a.form = 'initials' THEN 'initials' ELSE 'a full name' END) || ' here and the other way elsewhere' AS message
  FROM a JOIN m ON a.bib_id = m.bib_id AND a.family = m.family AND a.i = m.i AND a.form = m.form""")
def inconsistent_authors(spark, sf_dir):
    rows = T.authors(spark, sf_dir).select("bib_id", "ord", names.people("author").alias("names"))
    return bibwide.inconsistent_authors(rows).select("bib_id", "ord", "message")


S = """s AS (SELECT o_orderstatus AS bib_id, o_orderkey AS ord, year(o_orderdate) AS y, o_orderpriority AS venue, CASE WHEN o_orderkey % 3 <> 0 THEN 1 END AS doi,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 END AS arxiv, CASE WHEN o_orderkey % 10 = 0 THEN 'preprint' WHEN o_orderkey % 7 = 0 THEN 'book' ELSE 'journal-article' END AS kind, o_custkey % 50 = 0 AS own FROM orders),
t AS (SELECT bib_id, count(*) AS total, count(doi) AS with_doi, count(coalesce(doi, arxiv)) AS with_identifier, count(*) FILTER (WHERE kind = 'preprint' OR (arxiv IS NOT NULL AND doi IS NULL)) AS preprints,
  count(*) FILTER (WHERE own) AS self_citations, CAST(floor(median(y)) AS INTEGER) AS median_year, CAST(min(y) AS INTEGER) AS oldest_year, CAST(max(y) AS INTEGER) AS newest_year,
  count(*) FILTER (WHERE 2005 - y > 10) AS older_than_10y FROM s GROUP BY bib_id)"""


@query(f"WITH {S} SELECT * FROM t")
def bib_stats(spark, sf_dir):
    return stats.totals(T.statistics(spark, sf_dir), 2005, ["self"])


def _top(name):
    return f"""WITH {S}, n AS (SELECT bib_id, {name} AS name, count(*) AS n, min(ord) AS first FROM s GROUP BY bib_id, {name})
  SELECT bib_id, name, n, CAST(row_number() OVER (PARTITION BY bib_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM n"""


@query(f"SELECT * FROM ({_top('venue')}) WHERE rank <= 5")
def top_venues(spark, sf_dir):
    return stats.top_counts(T.statistics(spark, sf_dir), "venue").withColumnRenamed("venue", "name")


@query(_top("kind"))
def kinds_by_count(spark, sf_dir):
    return stats.top_counts(T.statistics(spark, sf_dir), "kind", None).withColumnRenamed("kind", "name")


@query(f"""WITH {S}, n AS (SELECT bib_id, venue, count(*) AS c, min(ord) AS first FROM s GROUP BY bib_id, venue),
  top AS (SELECT bib_id, arg_max(venue, (c, -first)) AS venue, max(c) AS c FROM n GROUP BY bib_id)
  SELECT t.bib_id, concat_ws('|',
    CASE WHEN preprints / total > 0.35 THEN preprints || ' of ' || total || ' references are preprints (' || CAST(round_even(100.0 * preprints / total, 0) AS INTEGER) || '%); check whether any have since been published' END,
    CASE WHEN self_citations / total > 0.25 THEN self_citations || ' of ' || total || ' are self-citations (' || CAST(round_even(100.0 * self_citations / total, 0) AS INTEGER) || '%)' END,
    CASE WHEN (total - with_identifier) / total > 0.2 THEN (total - with_identifier) || ' references carry no DOI or arXiv id, so they cannot be verified automatically' END,
    CASE WHEN older_than_10y / total > 0.6 AND total >= 8 THEN older_than_10y || ' of ' || total || ' references are more than 10 years old' END,
    CASE WHEN total >= 8 AND c / total > 0.4 THEN c || ' of ' || total || ' references come from ' || venue END) AS notes
  FROM t JOIN top ON t.bib_id = top.bib_id""")
def stats_notes(spark, sf_dir):
    return stats.summarise(T.statistics(spark, sf_dir), 2005, ["self"]).select("bib_id", F.array_join("notes", "|").alias("notes"))


L = """last AS (SELECT CAST(user_id AS VARCHAR) AS identifier, arg_max(CASE WHEN event_type = 'signup' THEN 404 ELSE 200 END, (ts, event_id)) AS status, max(ts) AS fetched_at
  FROM events WHERE event_type <> 'error' GROUP BY user_id), now AS (SELECT max(ts) AS t FROM events)"""


@query(f"""WITH {L} SELECT identifier, CAST(status AS INTEGER) AS status, CASE WHEN fetched_at + INTERVAL 2 DAY < t THEN 'miss' WHEN status = 404 THEN 'not_found' ELSE 'found' END AS outcome, FALSE AS stale FROM last, now""")
def cache_lookup(spark, sf_dir):
    rows = T.ledger(spark, sf_dir)
    now = rows.agg(F.max("fetched_at")).first()[0]
    return ledger.look_up(rows, F.lit(now).cast("timestamp_ntz"), ["identifier"], "event_id", ttl_days=2).select("identifier", "status", "outcome", "stale")


@query(f"WITH {L} SELECT identifier, CASE WHEN status = 404 THEN 'not_found' ELSE 'found' END AS outcome, fetched_at + INTERVAL 2 DAY < t AS stale FROM last, now")
def cache_lookup_offline(spark, sf_dir):
    rows = T.ledger(spark, sf_dir)
    now = rows.agg(F.max("fetched_at")).first()[0]
    return ledger.look_up(rows, F.lit(now).cast("timestamp_ntz"), ["identifier"], "event_id", ttl_days=2, offline=True).select("identifier", "outcome", "stale")


@query(f"WITH {L} SELECT identifier, CAST(status AS INTEGER) AS status, 'work/' || sha256(identifier) AS cache_key FROM last")
def cache_never_stores_5xx(spark, sf_dir):
    kept = ledger.latest(T.ledger(spark, sf_dir), ["identifier"], "event_id")
    return kept.select("identifier", "status", ledger.ledger_key(F.col("namespace"), F.col("identifier")).alias("cache_key"))


@query("""SELECT page_id, left(url, 80) AS local FROM pages WHERE regexp_matches(url, '(?i)https?://') AND page_id % 4 <> 0 AND page_id % 6 <> 0""")
def url_hygiene(spark, sf_dir):
    i = F.col("page_id")
    rows = T.as_entries(T.table(spark, sf_dir, "pages"), F.lit("web"), i, {"url": F.col("url"), "doi": F.when(i % 4 == 0, "10.1/x"), "urldate": F.when(i % 6 == 0, "2020-01-01")}, "online")
    return rows.select(F.col("ord").cast("long").alias("page_id"), F.get(rules.url_only(), F.lit(0)).alias("p")).filter("p is not null").select("page_id", "p.local")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS start, CAST(l_partkey % 3000 AS INTEGER) AS stop FROM lineitem),
  x AS (SELECT *, CAST(start AS VARCHAR) AS a, CAST(stop AS VARCHAR) AS b FROM t),
  y AS (SELECT *, CAST(CASE WHEN length(b) < length(a) AND NOT ends_with(a, b) THEN left(a, length(a) - length(b)) || b ELSE b END AS INTEGER) AS reached FROM x)
  SELECT l_orderkey, l_linenumber, start, stop, CASE WHEN start > reached THEN 'warn' ELSE 'info' END AS severity FROM y WHERE start > reached OR reached - start > 2000""")
def pages_sanity(spark, sf_dir):
    """Ranges made of quantities and part keys; a shorter end takes its first digits from the start."""
    q, p = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 3000).cast("int")
    raw = F.concat_ws("--", q.cast("string"), p.cast("string"))
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("start"), p.alias("stop"), raw.alias("raw"))
    rows = rows.withColumn("pages", scalars.pages_of(F.col("raw"))).withColumn("fields", F.create_map(F.lit("pages"), F.col("raw")))
    found = rows.select("l_orderkey", "l_linenumber", "start", "stop", F.explode_outer(F.filter(rules.page_span(), lambda x: x.isNotNull())).alias("p")).filter("p is not null")
    return found.select("l_orderkey", "l_linenumber", "start", "stop", "p.severity")


@query("""SELECT o_orderkey, CAST(nullif(regexp_extract(year(o_orderdate) || '-' || o_orderkey, '(1[6-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})', 1), '') AS INTEGER) AS y,
  regexp_extract('vol. ' || o_custkey || ' (' || o_orderkey || ')', '[0-9]+') AS v FROM orders""")
def parse_year_volume(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    return T.table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.year_of(F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), k)).alias("y"), scalars.volume_of(F.concat(F.lit("vol. "), F.col("o_custkey").cast("string"), F.lit(" ("), k, F.lit(")"))).alias("v")
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN NULL ELSE '10.5555/doc.' || doc_id END AS doi FROM documents""")
def extract_doi(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    forms = [
        ("doi", F.concat(F.lit("10.5555/DOC."), i)), ("doi", F.concat(F.lit(" {https://doi.org/10.5555/doc."), i, F.lit("}"))), ("url", F.concat(F.lit("http://dx.doi.org/10.5555/doc."), i, F.lit("."))),
        ("note", F.concat(F.lit("see doi: 10.5555/Doc."), i, F.lit(", p. 3"))), ("ee", F.concat(F.lit("urn:doi:10.5555/doc."), i)), ("howpublished", F.concat(F.lit("\"10.5555/doc."), i, F.lit("\" online"))), ("doi", F.concat(F.lit("publisher site "), i)),
    ]
    k = F.col("doc_id") % 7
    field = lambda name: F.coalesce(*[F.when(k == n, v) for n, (f, v) in enumerate(forms) if f == name], F.lit(None).cast("string"))
    return T.table(spark, sf_dir, "documents").select("doc_id", identifiers.extract_doi(field).alias("doi"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE '2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS arxiv FROM documents""")
def extract_arxiv(spark, sf_dir):
    i = F.concat(F.lit("2101."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    forms = [("eprint", F.concat(F.lit("arXiv:"), i, F.lit("v2"))), ("doi", F.concat(F.lit("https://doi.org/10.48550/arXiv."), i)), ("url", F.concat(F.lit("https://arxiv.org/abs/"), i, F.lit("v1"))), ("journal", F.concat(F.lit("arXiv preprint arXiv:"), i)), ("eprint", i), ("note", F.concat(F.lit("number "), i))]
    k = F.col("doc_id") % 6
    field = lambda name: F.coalesce(*[F.when(k == n, v) for n, (f, v) in enumerate(forms) if f == name], F.lit(None).cast("string"))
    return T.table(spark, sf_dir, "documents").select("doc_id", identifiers.extract_arxiv(field).alias("arxiv"))


_DULL = "', '".join(["a", "an", "the", "of", "on", "in", "for", "and", "or", "to", "with", "using", "via", "towards", "toward", "into", "from", "by", "at", "as", "is", "are", "new", "novel", "improved", "efficient", "learning", "deep", "approach", "method", "study", "analysis", "based"])


@query(f"""SELECT p_partkey, left(split_part(p_name, ' ', 2), 20) || (1990 + p_partkey % 30) || coalesce(left(list_filter(list_transform(string_split(lower(p_type), ' '), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ('{_DULL}'))[1], 14), '') AS base FROM part""")
def suggested_keys(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", suggest_key(F.split_part("p_name", F.lit(" "), F.lit(2)), (1990 + F.col("p_partkey") % 30).cast("int"), F.col("p_type")).alias("base"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 2) || (CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr(CAST(n + 96 AS INTEGER)) ELSE CAST(n - 25 AS VARCHAR) END) AS key
  FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, split_part(p_name, ' ', 2) ORDER BY p_partkey) - 1 AS n FROM part)""")
def unique_key(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("base"))
    return unique_keys(rows, "base", ["p_partkey"], ["p_brand"]).select("p_partkey", "key")


@query(f"""WITH t AS (SELECT doc_id, source, {TITLE_KEY.format(x='text')} AS k FROM documents),
  x AS (SELECT doc_id, source, list_distinct(string_split(k, ' ')) AS w FROM t WHERE k <> '')
  SELECT a.doc_id AS left_id, b.doc_id AS right_id, round(2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)), 6) AS dice FROM x a JOIN x b ON a.doc_id + 20 = b.doc_id""")
def token_dice(spark, sf_dir):
    """Each document's words against those of the twentieth after it; keys are made and split once, ahead of the join."""
    keyed = T.table(spark, sf_dir, "documents").select("doc_id", latex.title_keys("text").alias("k"))
    words = keyed.select("doc_id", similarity.tokens(F.col("k")).alias("w")).filter(F.size("w") > 0)
    # One shuffle: a document meets its partner as a pair of rows with the left one's id.
    sides = words.select(F.explode(F.array(F.struct(F.col("doc_id").alias("left_id"), F.lit(True).alias("left")), F.struct((F.col("doc_id") - 20).alias("left_id"), F.lit(False).alias("left")))).alias("s"), "w")
    pick = lambda left: F.collect_list(F.when(F.col("s.left") == left, F.col("w")))
    met = sides.groupBy(F.col("s.left_id").alias("left_id")).agg(pick(True).alias("a"), pick(False).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    pairs = met.select("left_id", (F.col("left_id") + 20).alias("right_id"), F.explode("a").alias("a"), "b").select("left_id", "right_id", "a", F.explode("b").alias("b"))
    return pairs.select("left_id", "right_id", F.round(similarity.shared(F.col("a"), F.col("b")), 6).alias("dice"))


P = """
p AS (SELECT p_partkey AS k, p_brand AS bib_id, CAST(p_partkey AS INTEGER) AS ord, 1950 + p_partkey % 60 AS year, upper(p_name[1:1]) AS i,
  upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS family, upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] AS given,
  ['a' || p_partkey % 1499, 'b' || p_partkey % 997, 'c' || p_partkey % 613, 'd' || p_partkey % 389] AS words FROM part),
e AS (SELECT *, array_to_string(words, ' ') AS title, CASE WHEN k % 3 = 0 THEN '10.5555/part.' || k END AS doi, given || ' ' || family AS author FROM p),
there AS (SELECT * FROM p WHERE k % 7 <> 6),
w0 AS (SELECT k, '10.5555/part.' || k AS doi, CASE WHEN k % 5 = 1 THEN list_reverse(words) WHEN k % 5 = 2 AND k % 3 = 0 THEN [words[1], words[2], 'other' || k, 'title'] WHEN k % 5 = 3 THEN list_append(words, 'revisited') ELSE words END AS words,
    year - (CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS year FROM there
  UNION ALL SELECT k, '10.5555/short.' || k, words[1:3], year FROM there WHERE k % 6 = 1
  UNION ALL SELECT k, '10.5555/first.' || k, words[1:2], year FROM there WHERE k % 6 = 1
  UNION ALL SELECT k, '10.5555/again.' || k, words, year + 3 FROM there WHERE k % 10 = 4),
w AS (SELECT w0.*, array_to_string(w0.words, ' ') AS title, CASE WHEN w0.k % 4 = 1 THEN 'Other' WHEN w0.k % 4 <> 3 THEN p.family END AS family,
  (CASE WHEN w0.k % 4 = 2 THEN p.i || '.' ELSE p.given END) AS given FROM w0 JOIN p ON w0.k = p.k),
known AS (SELECT e.bib_id, e.ord, e.k, e.title, e.words, e.author, e.family, w.doi, w.title AS wtitle, w.words AS wwords, w.given || ' ' || w.family AS wauthor, w.family AS wfamily FROM e JOIN w ON e.doi = w.doi),
hits AS (SELECT e.bib_id, e.ord, e.k, e.title, e.family, e.year, w.doi, w.title AS wtitle, w.family AS wfamily, w.year AS wyear,
    2.0 * len(list_intersect(e.words, w.words)) / (len(e.words) + len(w.words)) AS share FROM e JOIN w ON list_has_any(e.words, w.words) WHERE e.doi IS NULL),
top AS (SELECT *, dense_rank() OVER (PARTITION BY bib_id, ord ORDER BY share DESC, wtitle) - 1 AS pos FROM hits WHERE share >= 0.4),
scored AS (SELECT *, round_even(0.60 * (CASE WHEN share = 1 THEN 1.0 ELSE greatest(share, 2.0 * least(length(title), length(wtitle)) / (length(title) + length(wtitle))) END)
    + 0.25 * (CASE WHEN wfamily IS NULL THEN 0.5 WHEN wfamily = family THEN 1.0 ELSE 0.0 END)
    + 0.15 * (CASE abs(year - wyear) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.3 ELSE 0.0 END), 4) AS score FROM top WHERE pos < 5),
best AS (SELECT bib_id, ord, max(score) AS score, arg_max(doi, (score, -pos)) AS doi FROM scored GROUP BY bib_id, ord)
"""


def _part_resolved(spark, sf_dir):
    works = T.part_works(spark, sf_dir)
    return resolve(entry_facts(T.part_entries(spark, sf_dir)), works, T.no_replies(spark, works))


@query(f"WITH {P} SELECT bib_id, ord, 'title_mismatch' AS code, 'warn' AS severity, title AS local, wtitle AS authoritative FROM known WHERE NOT starts_with(wtitle, title) AND len(list_intersect(words, wwords)) < 4")
def title_mismatch(spark, sf_dir):
    """Titles of parts: in another order or longer they agree, with half of the words replaced they do not."""
    return _codes(_part_resolved(spark, sf_dir), "title_mismatch")


@query(f"WITH {P} SELECT bib_id, ord, 'author_mismatch' AS code, 'warn' AS severity, author AS local, wauthor AS authoritative FROM known WHERE wfamily IS NOT NULL AND wfamily <> family")
def author_mismatch(spark, sf_dir):
    """An initial agrees with the name that it begins; no author at all is no disagreement."""
    return _codes(_part_resolved(spark, sf_dir), "author_mismatch")


@query(f"WITH {P} SELECT bib_id, ord, 'withdrawn' AS code, 'critical' AS severity, doi AS local FROM known WHERE k % 17 = 0")
def withdrawn_works(spark, sf_dir):
    return _codes(_part_resolved(spark, sf_dir), "withdrawn").drop("authoritative")


@query("SELECT p_brand AS bib_id, CAST(p_partkey AS INTEGER) AS ord, 'malformed_doi' AS code, 'warn' AS severity, 'see part ' || p_partkey AS local FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 9 = 1")
def malformed_doi(spark, sf_dir):
    return _codes(_part_resolved(spark, sf_dir), "malformed_doi").drop("authoritative")


@query(f"WITH {P} SELECT bib_id, ord, CAST(pos AS INTEGER) AS pos, doi AS hit FROM top WHERE pos < 5")
def title_search(spark, sf_dir):
    """Works that share most words with the title of an entry without a DOI; works of one title share a place."""
    untied = entry_facts(T.part_entries(spark, sf_dir)).filter("doi is null")
    return candidates(untied, T.part_works(spark, sf_dir)).select("bib_id", "ord", "pos", F.col("known.doi").alias("hit"))


@query(f"WITH {P} SELECT e.bib_id, e.ord, CASE WHEN best.score >= 0.65 THEN 'found' ELSE 'not_found' END AS outcome, CASE WHEN best.score >= 0.65 THEN best.score END AS confidence, CASE WHEN best.score >= 0.65 THEN best.doi END AS matched FROM e LEFT JOIN best ON e.bib_id = best.bib_id AND e.ord = best.ord WHERE e.doi IS NULL")
def match_confidence_top1(spark, sf_dir):
    """The best hit of each title search and how far it is believed; one title is the beginning of the other or its words decide."""
    untied = entry_facts(T.part_entries(spark, sf_dir)).filter("doi is null")
    hits = best_match(untied, candidates(untied, T.part_works(spark, sf_dir)))
    return hits.select("bib_id", "ord", "outcome", "confidence", F.col("known.doi").alias("matched"))


@query(f"WITH {P} SELECT bib_id, ord, 'low_confidence_match' AS code, 'warn' AS severity, round_even(score, 3) AS confidence FROM best WHERE score >= 0.65 AND score < 1")
def low_confidence_match(spark, sf_dir):
    found = resolve(entry_facts(T.part_entries(spark, sf_dir)), T.part_works(spark, sf_dir))
    return rules.entry_problems(found, only=("existence",)).filter("code = 'low_confidence_match'").select("bib_id", "ord", "code", "severity", "confidence")


@query(f"""WITH {P}, f AS (SELECT e.bib_id, e.ord, e.key, (e.doi IS NOT NULL AND w.doi IS NOT NULL) OR coalesce(best.score >= 0.65, FALSE) AS found,
    coalesce((CASE WHEN e.doi IS NOT NULL THEN w.doi IS NULL OR e.k % 17 = 0 ELSE best.score >= 0.65 AND e.k % 17 = 0 END), FALSE) AS critical
    FROM (SELECT *, 'd' || k AS key FROM e) e LEFT JOIN w ON e.doi = w.doi LEFT JOIN best ON e.bib_id = best.bib_id AND e.ord = best.ord)
  SELECT bib_id, ord, key, found, critical FROM f""")
def title_verdicts(spark, sf_dir):
    """Which entries are found, by DOI or by title, and which have a critical finding."""
    found = resolve(entry_facts(T.part_entries(spark, sf_dir)), T.part_works(spark, sf_dir))
    reports = verdict.row_reports(rules.with_findings(found))
    return reports.select("bib_id", "ord", "key", F.col("resolved").alias("found"), (F.col("status") == "critical").alias("critical"))


@query("""WITH e AS (SELECT CAST(o_orderkey AS INTEGER) AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'misc' END AS t, o_orderkey % 2 = 0 AS a, o_orderkey % 5 <> 0 AS v, o_orderkey % 4 = 0 AS ed FROM orders)
  SELECT ord, 'warn' AS severity, CASE WHEN t = 'article' THEN concat_ws(', ', CASE WHEN NOT a AND NOT ed THEN 'author' END, CASE WHEN NOT v THEN 'journal' END) ELSE 'publisher' END AS missing
  FROM e WHERE (t = 'article' AND ((NOT a AND NOT ed) OR NOT v)) OR (t = 'book' AND NOT v)
  UNION ALL SELECT ord, 'info', CASE t WHEN 'article' THEN 'volume, number, pages' WHEN 'book' THEN concat_ws(', ', CASE WHEN NOT a THEN 'author' END, 'edition') ELSE 'howpublished, url' END FROM e""")
def style_missing_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "article").when(k % 3 == 1, "book").otherwise("misc")
    v = k % 5 != 0
    fields = {"title": F.lit("t"), "year": F.lit("2000"), "author": F.when(k % 2 == 0, "A B"), "editor": F.when(k % 4 == 0, "C D"), "journal": F.when((k % 3 == 0) & v, "J"), "publisher": F.when((k % 3 == 1) & v, "P")}
    rows = T.as_entries(T.table(spark, sf_dir, "orders"), F.lit("o"), k, fields, kind)
    found = rows.select("ord", F.explode(F.filter(rules.style_fields("ieee"), lambda x: x.isNotNull())).alias("p"))
    return found.select("ord", "p.severity", F.regexp_replace(F.regexp_replace("p.message", "^IEEE style (needs|usually shows) ", ""), " on an @.*$", "").alias("missing"))


@query(f"""WITH {E}, ok AS (SELECT r.* FROM r JOIN v ON r.bib_id = v.bib_id AND r.ord = v.ord WHERE r.outcome = 'found' AND v.status <> 'critical')
  SELECT bib_id, ord, 'year' AS field, CAST(year AS VARCHAR) AS old, CAST(wyear AS VARCHAR) AS new FROM ok WHERE year <> wyear
  UNION ALL SELECT bib_id, ord, 'volume', volume, wvolume FROM ok WHERE volume <> wvolume
  UNION ALL SELECT bib_id, ord, 'pages', p0 || '-' || p1, w0 || '--' || w1 FROM ok WHERE p0 || '-' || p1 <> w0 || '-' || w1""")
def plan_fixes(spark, sf_dir):
    return fixes.plan_row_fixes(rules.with_findings(_resolved(spark, sf_dir))).select("bib_id", "ord", "field", "old", "new")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_-]+'), lambda r: r <> '')) AS run FROM documents),
  x AS (SELECT doc_id, unnest(list_concat(list_filter(regexp_extract_all(regexp_replace(run, '[^A-Za-z0-9_-]', '_', 'g'), '\\b[A-Z][A-Z0-9]+(?:-[A-Z0-9]+)*s?\\b'), lambda w: upper(w) NOT IN ('A', 'AN', 'THE', 'AND', 'OR', 'OF', 'IN', 'ON', 'FOR', 'TO', 'I', 'II', 'III', 'IV')),
    list_filter(string_split(run, '-'), lambda w: regexp_matches(w, '[a-z][A-Z]')))) AS w FROM t)
  SELECT doc_id, count(DISTINCT w) AS n FROM x GROUP BY doc_id""")
def case_protection(spark, sf_dir):
    """Acronyms and words with inner capitals of whole texts. The texts hold no braces; those are in the golden cases."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", rules.case_facts("text").alias("case"))
    return rows.select("doc_id", F.explode("case.words").alias("w")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


MARKS = """t AS (SELECT conv_id, turn, conv_id % 40 + 1 AS a, conv_id % 40 + 1 + turn % 5 AS b, turn % 30 + 1 AS c FROM conversations)"""


@query(f"""WITH {MARKS}, m AS (SELECT conv_id, turn, unnest(list_concat(CASE WHEN b > a THEN generate_series(a, b) ELSE [] END, [c])) AS n FROM t)
  SELECT conv_id, turn, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS marks FROM (SELECT DISTINCT * FROM m) GROUP BY conv_id, turn""")
def cited_markers_expanded(spark, sf_dir):
    """Numbers in brackets, with ranges; a range that goes nowhere names nothing."""
    a, c = F.col("conv_id") % 40 + 1, F.col("turn") % 30 + 1
    text = F.concat(F.lit("as in ["), a.cast("string"), F.lit("-"), (a + F.col("turn") % 5).cast("string"), F.lit("] and ["), c.cast("string"), F.lit("], not [x]"))
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(reflist.cited_markers(text), ",").alias("marks"))


@query("""WITH v AS (SELECT p_brand AS bib_id, CAST(p_partkey AS INTEGER) AS ord, CASE p_partkey % 3 WHEN 0 THEN 'Journal of Small ' ELSE 'Trans. Small ' END || upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] || ' Things' AS spelling,
    p_name[1:1] AS i FROM part),
  g AS (SELECT bib_id, i, arg_max(spelling, (length(spelling), -first)) AS canonical, count(*) AS n FROM (SELECT bib_id, i, spelling, min(ord) AS first FROM v GROUP BY bib_id, i, spelling) GROUP BY bib_id, i)
  SELECT v.bib_id, v.ord, v.spelling AS local, g.canonical AS authoritative FROM v JOIN g ON v.bib_id = g.bib_id AND v.i = g.i WHERE g.n > 1 AND v.spelling <> g.canonical""")
def inconsistent_venue_names(spark, sf_dir):
    """Venues whose telling words begin alike count as one: neither "journal" nor "trans" tells."""
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    spelling = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Journal of Small ").otherwise("Trans. Small "), F.initcap(first), F.lit(" Things"))
    rows = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("bib_id"), F.col("p_partkey").cast("int").alias("ord"), spelling.alias("spelling"))
    return bibwide.inconsistent_venues(rows.select("*", latex.venue_keys("spelling").alias("venue_key"))).select("bib_id", "ord", "local", "authoritative")


# -- golden queries ------------------------------------------------------------------

_TEXT = [
    (r"Caf\'{e}", "Café"), (r"Caf\'e", "Café"), (r"{\'{\i}}", "í"), (r"Schr{\"o}dinger", "Schrödinger"), (r"Erd{\H{o}}s", "Erdős"), (r"\c{c}a", "ça"), (r"na\"{\i}ve", "naïve"), (r"stra{\ss}e", "straße"),
    (r"\O{}re", "Øre"), (r"{BERT}: a {S}tudy", "BERT: a Study"), (r"R\&D", "R&D"), (r"50\%", "50%"), (r"$x^2$ norm", "x^2 norm"), (r"\emph{very} big", "very big"), ("a---b--c", "a—b–c"), ("``quoted''", "“quoted”"),
    ("Dr.~Who", "Dr. Who"), (r"\unknowncmd{x}", r"\unknowncmdx"), ("  spaced\n out ", "spaced out"), (r"\ldots and", "… and"), (r"{\it Foo} bar", "Foo bar"), ("plain", "plain"), (r"$\alpha$-beta", "α-beta"),
]
golden("latex_to_unicode", "raw string", [(r,) for r, _ in _TEXT], lambda d: d.select("raw", latex.unicode_text("raw").alias("text")), "raw:VARCHAR text:VARCHAR", _TEXT)

_KEYS = [(r"Caf\'{e}s: A {Study}", "cafes study"), ("Cafés - a study", "cafes study"), ("Research & Development", "research and development"), (r"The {ResNet} Paper", "resnet paper"), ("State-of-the-Art", "state of art"), ("Straße/Øre", "strasse ore"), ("", "")]
golden("title_key_golden", "raw string", [(r,) for r, _ in _KEYS], lambda d: d.select("raw", latex.title_keys("raw").alias("key")), "raw:VARCHAR key:VARCHAR", _KEYS)

_PAGES = [("10--20", "10", "20"), ("10-20", "10", "20"), ("10 to 20", "10", "20"), ("1234--56", "1234", "1256"), ("1234--34", "1234", "34"), ("e1234", "e1234", None), ("42", "42", None), ("1,234--1,240", "1234", "1240"), ("12–15", "12", "15"), ("n/a", None, None), ("", None, None)]
golden("parse_pages", "raw string", [(r,) for r, *_ in _PAGES], lambda d: d.select("raw", scalars.pages_of(F.col("raw")).alias("p")).select("raw", "p.start", F.col("p.end").alias("stop")), "raw:VARCHAR start:VARCHAR stop:VARCHAR", _PAGES)

_YEARS = [("2020", 2020), ("{2020}", 2020), ("2020-06", 2020), ("Jan 2020", 2020), ("12019", 2019), ("in press", None), ("1599", None)]
golden("parse_year", "raw string", [(r,) for r, _ in _YEARS], lambda d: d.select("raw", scalars.year_of(F.col("raw")).alias("y")), "raw:VARCHAR y:INTEGER", _YEARS)

_NAMES = [
    ("Ashish Vaswani", "Vaswani", "Ashish", "vaswani", "a"), ("Vaswani, Ashish", "Vaswani", "Ashish", "vaswani", "a"), ("Ludwig van Beethoven", "van Beethoven", "Ludwig", "vanbeethoven", "l"), ("Martin Luther King, Jr.", "King", "Martin Luther", "king", "m"),
    ("King, Jr., Martin Luther", "King", "Martin Luther", "king", "m"), ("{Smith and Wesson Ltd.}", "Smith and Wesson Ltd.", "", "smithandwessonltd", ""), (r"Sch{\"o}lkopf, Bernhard", "Schölkopf", "Bernhard", "scholkopf", "b"), ("Plato", "Plato", "", "plato", ""), (r"Erd{\H{o}}s, P\'{a}l", "Erdős", "Pál", "erdos", "p"),
]
golden("parse_name", "raw string", [(r[0],) for r in _NAMES], lambda d: d.select("raw", names.one_person("raw").alias("p")).select("raw", "p.family", "p.given", "p.family_key", "p.given_initial"), "raw:VARCHAR family:VARCHAR given:VARCHAR family_key:VARCHAR given_initial:VARCHAR", _NAMES)

_LISTS = [("Vaswani, Ashish and Shazeer, Noam and others", ["Vaswani, Ashish", "Shazeer, Noam"]), ("{Smith and Wesson} and Doe, J.", ["Smith and Wesson", "Doe, J."]), ("A. B. AND C. D.", ["A. B.", "C. D."]), ("", [])]
golden("split_authors", "raw string", [(r,) for r, _ in _LISTS], lambda d: d.select("raw", F.transform(names.people("raw"), lambda p: p["display"]).alias("shown")), "raw:VARCHAR shown:VARCHAR[]", _LISTS)

_PAIRS = [("J. Smith", "John Smith", True), ("A. Smith", "John Smith", False), ("Smith", "Schmidt", False), ("Smith, John", "John Smith and Jane Doe", True), ("Jane Doe and John Smith", "John Smith and Jane Doe", False), ("A B and C D and E F", "A B", False), (r"P\'{e}rez, Jos\'{e}", "Perez, J.", True)]
golden("authors_match", "a string, b string", [p[:2] for p in _PAIRS], lambda d: d.select("a", "b", names.people("a").alias("x"), names.people("b").alias("y")).select("a", "b", names.people_match(F.col("x"), F.col("y")).alias("same")), "a:VARCHAR b:VARCHAR same:BOOLEAN", _PAIRS)

_DOIS = [("https://doi.org/10.1109/ABC.2020", "10.1109/abc.2020"), ("doi:10.1109/abc.2020", "10.1109/abc.2020"), ("{10.1109/ABC.2020}", "10.1109/abc.2020"), ("http://dx.doi.org/10.1000/x.", "10.1000/x"), ("info:doi/10.1000/x", "10.1000/x"), ("10.1/x", None), ("see the publisher website", None), ("10.1000/a(b)", "10.1000/a(b"), ("", None)]
golden("normalize_doi", "raw string", [(r,) for r, _ in _DOIS], lambda d: d.select("raw", identifiers.normalize_doi(F.col("raw")).alias("doi")), "raw:VARCHAR doi:VARCHAR", _DOIS)

_ARXIV = [("arXiv:2103.14030v2", "2103.14030"), ("2103.14030", "2103.14030"), ("cs/9901002", "cs/9901002"), ("math.GT/0309136", "math.GT/0309136"), ("https://arxiv.org/abs/2103.14030v1", "2103.14030"), ("10.48550/arXiv.2103.14030", "2103.14030"), ("10.5555/3295222.3295349", None), ("nothing", None)]
golden("normalize_arxiv", "raw string", [(r,) for r, _ in _ARXIV], lambda d: d.select("raw", identifiers.normalize_arxiv(F.col("raw")).alias("arxiv")), "raw:VARCHAR arxiv:VARCHAR", _ARXIV)

_CITES = [
    (r"\cite{a} \citep[see][p.~2]{b, c} % \cite{old}", ["a", "b", "c"]), (r"50\% of \textcite{x} and \autocite*{y}", ["x", "y"]), ("As [@smith2020; -@doe1999] and @roe. say", ["doe1999", "roe", "smith2020"]), (r"\nocite{*} \footcite{z}", ["z"]), ("mail a@b.c", []), ("none", []),
]
golden("citation_keys", "raw string", [(r,) for r, _ in _CITES], lambda d: d.select("raw", bibwide.citation_keys(F.col("raw")).alias("keys")), "raw:VARCHAR keys:VARCHAR[]", _CITES)

_MARKS = [("see [1], [2]", ["1", "2"]), ("[1-3] and [7]", ["1", "2", "3", "7"]), ("[1]-[3]", ["1", "3"]), ("[1, 4–6]", ["1", "4", "5", "6"]), ("[1-900]", []), ("[a] [] 12", [])]
golden("cited_markers", "raw string", [(r,) for r, _ in _MARKS], lambda d: d.select("raw", reflist.cited_markers(F.col("raw")).alias("marks")), "raw:VARCHAR marks:VARCHAR[]", _MARKS)

_VENUES = [("v", 0, "IEEE Transactions on Pattern Analysis and Machine Intelligence"), ("v", 1, "IEEE Trans. Pattern Anal. Mach. Intell."), ("v", 2, "Nature"), ("v", 3, "IEEE Transactions on Pattern Analysis and Machine Intelligence"), ("u", 0, "IEEE Trans. Pattern Anal. Mach. Intell.")]
golden("inconsistent_venues", "bib_id string, ord int, spelling string", _VENUES, lambda d: bibwide.inconsistent_venues(d.select("*", latex.venue_keys("spelling").alias("venue_key"))).select("bib_id", "ord", "local", "authoritative"), "bib_id:VARCHAR ord:INTEGER local:VARCHAR authoritative:VARCHAR", [("v", 1, _VENUES[1][2], _VENUES[0][2])])

BIB = r"""@article{vaswani2017attention,
  title     = {Attention Is All You Need},
  author    = {Vaswani, Ashish and Shazeer, Noam and others},
  journal   = "Advances in " # nips,
  year      = 2017,
  doi       = {10.5555/3295222.3295349}
}
@comment{ignored @article{no, title={x}}}
@misc{lewis2020, title = {Longformer: The {Long} Document}, eprint = {2004.05150}, archivePrefix = {arXiv}}
@article{vaswani2017attention, title = {Again}}
@book{twice, title = {First}, title = {Second}, year = {2020}}
@article{broken2020,
  title = {This Never Closes,
  year = {2020}
@book{last2021, title = {Recovered}, year = {2021}}
"""
_SCAN = [("vaswani2017attention", "article", 1, "Attention Is All You Need", "title,author,journal,year,doi"), ("lewis2020", "misc", 9, "Longformer: The {Long} Document", "title,eprint,archivePrefix"), ("twice", "book", 11, "First", "title,year"), ("last2021", "book", 15, "Recovered", "title,year")]
golden("bibtex_scan", "bib_id string, text string", [("b", BIB)], lambda d: bibtex.entries_of(bibtex.parse(d)).select("key", "entry_type", "start_line", F.col("fields")["title"].alias("title"), F.array_join("field_order", ",").alias("fields")), "key:VARCHAR entry_type:VARCHAR start_line:INTEGER title:VARCHAR fields:VARCHAR", _SCAN)
golden("bibtex_problems", "bib_id string, text string", [("b", BIB)], lambda d: bibtex.problems_of(bibtex.parse(d)).select("seq", "code", "local", "authoritative"), "seq:INTEGER code:VARCHAR local:VARCHAR authoritative:VARCHAR", [(0, "duplicate_key", "vaswani2017attention", None), (1, "duplicate_field", "First", "Second"), (2, "malformed_entry", "line 12", None)])

REFS = [
    ("1", 'A. Vaswani, N. Shazeer, and I. Polosukhin, "Attention is all you need," in Advances in Neural Information Processing Systems, vol. 30, 2017, pp. 5998-6008.'),
    ("2", 'K. He and J. Sun, "Deep residual learning for image recognition," in Proc. IEEE Conf. Comput. Vis. Pattern Recognit. (CVPR), 2016, pp. 770-778. doi: 10.1109/CVPR.2016.90.'),
    ("3", 'I. Beltagy and A. Cohan, "Longformer: The long-document transformer," arXiv preprint arXiv:2004.05150, 2020.'),
    ("4", "Doe, J. (2020). The title of it. Some Venue, 12."),
    ("5", "nothing of use"),
]
_PARSED = [
    ("1", "Attention is all you need", "A. Vaswani, N. Shazeer, and I. Polosukhin", "2017", "Advances in Neural Information Processing Systems", "30", "5998--6008", None, None, 0.4, "inproceedings"),
    ("2", "Deep residual learning for image recognition", "K. He and J. Sun", "2016", "Proc. IEEE Conf. Comput. Vis. Pattern Recognit. (CVPR)", None, "770--778", "10.1109/cvpr.2016.90", None, 1.0, "inproceedings"),
    ("3", "Longformer: The long-document transformer", "I. Beltagy and A. Cohan", "2020", "arXiv", None, None, None, "2004.05150", 1.0, "misc"),
    ("4", "The title of it", "Doe, J", "2020", "Some Venue, 12", None, None, None, None, 0.4, "article"),
    ("5", None, None, None, "nothing of use", None, None, None, None, 0.0, "article"),
]


def _references(d):
    out = reflist.parse_references(d.select(F.lit("p").alias("bib_id"), F.col("marker").cast("int").alias("ord"), "marker", "raw"))
    return out.select("marker", "title", "authors", "year", "venue", "volume", "pages", "doi", "arxiv_id", "confidence", reflist.entry_type(F.col("venue"), F.col("raw"), F.col("arxiv_id")).alias("kind"))


golden("reference_list_scan", "marker string, raw string", REFS, _references, "marker:VARCHAR title:VARCHAR authors:VARCHAR year:VARCHAR venue:VARCHAR volume:VARCHAR pages:VARCHAR doi:VARCHAR arxiv_id:VARCHAR confidence:DOUBLE kind:VARCHAR", _PARSED)

PAPER = "Intro cites [1] and [2].\nReferences\n" + "\n".join(f"[{m}] {r}" for m, r in REFS)
golden("reference_splitter", "bib_id string, text string", [("p", PAPER), ("q", "no list here")], lambda d: reflist.references(d).select("bib_id", "ord", "marker", "raw"), "bib_id:VARCHAR ord:INTEGER marker:VARCHAR raw:VARCHAR", [("p", i, m, r) for i, (m, r) in enumerate(REFS)] + [("q", -1, None, None)])

WORKS = [
    ("resnet", '{"DOI":"10.1109/CVPR.2016.90","type":"proceedings-article","title":["Deep Residual Learning"],"author":[{"given":"Kaiming","family":"He"},{"name":"A Group"},{}],"page":"770-778","issued":{"date-parts":[[2016,6]]},"container-title":["CVPR"]}'),
    ("retracted", '{"DOI":"10.1016/s1","type":"journal-article","title":"Bare Title","updated-by":[{"type":"Retraction"},{"type":"correction"}],"created":{"date-parts":[["1998"]]},"publisher":"Pub"}'),
    ("preprint", '{"DOI":"10.48550/arXiv.2004.05150","type":"posted-content","subtype":"preprint","title":["", "Second"],"relation":{"is-preprint-of":[{"id":"bad"},{"id":"10.1000/PUB","id-type":"doi"}]},"issued":{"date-parts":[[null]]}}'),
    ("odd", '{"DOI":5,"title":{"a":1},"author":"x","issued":[],"updated-by":"no","relation":[],"type":["book"],"volume":7}'),
    ("broken", "not json"),
]
_WORKS = [
    ("resnet", "10.1109/cvpr.2016.90", "Deep Residual Learning", "He, Kaiming and A Group", 2016, "CVPR", "770-778", "conference-paper", False, False, None, None),
    ("retracted", "10.1016/s1", "Bare Title", None, 1998, "Pub", None, "journal-article", True, False, None, None),
    ("preprint", "10.48550/arxiv.2004.05150", "Second", None, None, None, None, "preprint", False, False, "2004.05150", "10.1000/pub"),
    ("odd", None, None, None, None, None, None, "other", False, False, None, None),
    ("broken", None, None, None, None, None, None, "other", False, False, None, None),
]
golden("work_mapping", "id string, message string", WORKS, lambda d: works.map_works(d).select("id", "doi", "title", scalars.present(names.display_people(F.col("authors"))).alias("people"), "year", "venue", scalars.pages_key(F.col("pages")).alias("pages"), "kind", "retracted", "withdrawn", "arxiv_id", "published_version_doi"), "id:VARCHAR doi:VARCHAR title:VARCHAR people:VARCHAR year:INTEGER venue:VARCHAR pages:VARCHAR kind:VARCHAR retracted:BOOLEAN withdrawn:BOOLEAN arxiv_id:VARCHAR published_version_doi:VARCHAR", _WORKS)

_CASE = [("A study of BERT and CNNs with ResNet", "BERT, CNNs, ResNet", "A study of {BERT} and {CNNs} with {ResNet}"), ("{BERT} protected, GPT-4 not", "GPT-4", "{BERT} protected, {GPT-4} not"), ("An ordinary Title IV", "", None), ("COVID-19 and iPhone", "COVID-19, iPhone", "{COVID-19} and {iPhone}")]
golden("case_protection_golden", "raw string", [(r,) for r, *_ in _CASE], lambda d: d.select("raw", rules.case_facts("raw").alias("c")).select("raw", F.array_join("c.words", ", ").alias("words"), "c.suggestion"), "raw:VARCHAR words:VARCHAR suggestion:VARCHAR", _CASE)


def _checked(d, manuscripts=None, style=None):
    """The literal bibliography of ``BIB`` against the literal registry."""
    found = works.map_works(d.sparkSession.createDataFrame(WORKS, "id string, message string")).drop("id")
    return check(bibtex.entries_of(bibtex.parse(d)), found, manuscripts, style)


GOLDEN = r"""@inproceedings{good2016,
  title     = {Deep Residual Learning},
  author    = {He, Kaiming},
  year      = {2016},
  pages     = {770--778},
  doi       = {10.1109/CVPR.2016.90}
}

@article{wrong2015,
  title = {Deep Residual Learning},
  author = {He, K.},
  year = {2015},
  pages = {770--779},
  doi = {https://doi.org/10.1109/cvpr.2016.90}
}

@article{fake2021,
  title   = {Invented_Work},
  author  = {Doe, Jane},
  year    = {2021},
  doi     = {10.9999/none}
}

@article{retracted1998,
  title = {Bare Title},
  author = {Someone, A.},
  year = {1998},
  doi = {10.1016/S1}
}
"""
_STATUS = [("good2016", "warn", "duplicate_work"), ("wrong2015", "warn", "year_mismatch,pages_mismatch,duplicate_work"), ("fake2021", "critical", "doi_not_found"), ("retracted1998", "critical", "retracted")]
golden("golden_run", "bib_id string, text string", [("g", GOLDEN)], lambda d: _checked(d).reports.select("key", "status", F.array_join(F.transform("problems", lambda p: p["code"]), ",").alias("codes")), "key:VARCHAR status:VARCHAR codes:VARCHAR", _STATUS)
golden("crosscheck_manuscript", "bib_id string, text string", [("g", GOLDEN)], lambda d: _checked(d, d.select("bib_id", F.lit(r"\cite{good2016, ghost}").alias("text"))).crosschecks, "bib_id:VARCHAR uncited:VARCHAR[] undefined:VARCHAR[]", [("g", ["wrong2015", "fake2021", "retracted1998"], ["ghost"])])


def _fixed(d):
    c = _checked(d)
    out = fixes.apply_fixes(d, c.resolved, fixes.plan_fixes(c.resolved, c.problems))
    return out.select("bib_id", F.array_sort("applied").alias("applied"), F.sha2("text", 256).alias("text_sha256"))


def _sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


golden("apply_fixes", "bib_id string, text string", [("g", GOLDEN)], _fixed, "bib_id:VARCHAR applied:VARCHAR[] text_sha256:VARCHAR", [("g", ["wrong2015: pages", "wrong2015: year"], _sha(GOLDEN.replace("{2015}", "{2016}").replace("{770--779}", "{770--778}")))])

_EXPORT = {
    "good2016": "@inproceedings{good2016,\n  title     = {Deep Residual Learning},\n  author    = {He, Kaiming and A Group},\n  booktitle = {CVPR},\n  pages     = {770--778},\n  year      = {2016},\n  doi       = {10.1109/cvpr.2016.90}\n}",
    "fake2021": "% unverified: this entry could not be resolved, and is as-read\n@article{fake2021,\n  title  = {Invented\\_Work},\n  author = {Doe, Jane},\n  year   = {2021},\n  doi    = {10.9999/none}\n}",
}
golden("export_bibtex", "bib_id string, text string", [("g", GOLDEN)], lambda d: export.render_entries(_checked(d).resolved).filter("ord in (0, 2)").select("ord", "text"), "ord:INTEGER text:VARCHAR", [(0, _EXPORT["good2016"]), (2, _EXPORT["fake2021"])])

_JSON = (
    '{"bib_path":"g","summary":{"ok":0,"warn":2,"critical":2,"unresolved":0,"network_error":0},"entries":['
    '{"key":"good2016","entry_type":"inproceedings","status":"warn","line":1,"problems":[{"code":"duplicate_work","severity":"warn","message":"the same work is also cited as wrong2015","local":"good2016","authoritative":"wrong2015"}]},'
    '{"key":"wrong2015","entry_type":"article","status":"warn","line":9,"problems":[{"code":"year_mismatch","severity":"warn","message":"year differs from the published record","field":"year","local":"2015","authoritative":"2016"},'
    '{"code":"pages_mismatch","severity":"warn","message":"pages differs from the published record","field":"pages","local":"770-779","authoritative":"770-778"},{"code":"duplicate_work","severity":"warn","message":"the same work is also cited as good2016","local":"wrong2015","authoritative":"good2016"}]},'
    '{"key":"fake2021","entry_type":"article","status":"critical","line":17,"problems":[{"code":"doi_not_found","severity":"critical","message":"DOI does not resolve","field":"doi","local":"10.9999/none","url":"https://doi.org/10.9999/none"}]},'
    '{"key":"retracted1998","entry_type":"article","status":"critical","line":24,"problems":[{"code":"retracted","severity":"critical","message":"this work has been RETRACTED","local":"10.1016/s1","url":"https://doi.org/10.1016/s1"}]}'
    '],"parse_problems":[],"crosscheck":null}'
)
golden("report_json", "bib_id string, text string", [("g", GOLDEN)], lambda d: export.report_json(_checked(d).reports), "bib_id:VARCHAR json:VARCHAR", [("g", _JSON)])

_ASKED = [("10.1109/CVPR.2016.90", "found", "he2016residual"), ("arXiv:2004.05150", "found", "second"), ("Bare Title", "found", "1998bare"), ("10.1000/none", "not_found", None)]
golden("cite_queries", "query string", [(q,) for q, *_ in _ASKED], lambda d: cite(d, works.map_works(d.sparkSession.createDataFrame(WORKS, "id string, message string")).drop("id")).select("query", "outcome", "key"), "query:VARCHAR outcome:VARCHAR key:VARCHAR", _ASKED)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
