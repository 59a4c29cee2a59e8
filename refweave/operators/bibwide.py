"""Rules over a whole bibliography: group-bys and anti-joins on bib_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.functions.latex import unicode_text, venue_keys
from refweave.functions.names import initials_only, people
from refweave.functions.scalars import present, stripped
from refweave.operators.rules import ORDER
from refweave.schema import field_of, problem

# Fixed words: what a venue's signature leaves out.
NOISE = (
    "proceedings", "proc", "the", "of", "on", "in", "and", "a", "an", "international", "intl", "conference", "conf", "symposium", "symp", "workshop",
    "annual", "journal", "transactions", "trans", "letters",
)


def as_problems(rows: DataFrame, rule: str, finding: Column, seq: Column | None = None) -> DataFrame:
    seq = F.lit(0) if seq is None else seq
    return rows.select("bib_id", "ord", F.lit(ORDER[rule]).alias("rule_ord"), seq.cast("int").alias("seq"), finding.alias("p")).select("bib_id", "ord", "rule_ord", "seq", "p.*")


def signatures() -> Column:
    """What says that two entries are one work: DOI, arXiv id, title key with year, in this order."""
    title = F.concat(F.lit("title:"), "title_key", F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("?")))
    return F.filter(F.array(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("arxiv:"), "arxiv_id"), title), lambda s: s.isNotNull())


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """(bib_id, seq, members): sets of two entries or more that share a signature, each set once, at its first appearance.

    ``members`` are (ord, key) in order. Sets are not merged: one of two and one
    of three that overlap are both given.
    """
    rows = entries.select("bib_id", "ord", "key", F.posexplode(signatures()).alias("pos", "signature"))
    sets = rows.groupBy("bib_id", "signature").agg(F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("members"), F.min(F.struct("ord", "pos")).alias("first"))
    once = sets.filter(F.size("members") > 1).groupBy("bib_id", "members").agg(F.min("first").alias("first"))
    return once.select("bib_id", (F.col("first.ord") * 3 + F.col("first.pos")).alias("seq"), "members")


def duplicates(entries: DataFrame) -> DataFrame:
    members = duplicate_groups(entries).select("bib_id", "seq", "members", F.explode("members").alias("m"))
    others = F.array_join(F.transform(F.filter("members", lambda x: x["ord"] != F.col("m.ord")), lambda x: x["key"]), ", ")
    rows = members.select("bib_id", "seq", F.col("m.ord").alias("ord"), F.col("m.key").alias("key"), others.alias("others"))
    return as_problems(rows, "duplicates", problem("duplicate_work", "warn", F.concat(F.lit("the same work is also cited as "), "others"), local=F.col("key"), authoritative=F.col("others")), F.col("seq"))


def venue_signature(venue_key: Column) -> Column:
    """First letters of a venue key's telling words."""
    return F.array_join(F.transform(F.filter(F.split(venue_key, " "), lambda w: (w != "") & ~w.isin(*NOISE)), lambda w: F.left(w, F.lit(1))), "")


def inconsistent_venues(spelled: DataFrame) -> DataFrame:
    """Findings for every spelling of a venue but the longest; ``spelled`` has bib_id, ord, spelling and venue_key."""
    rows = spelled.withColumn("sig", venue_signature(F.col("venue_key"))).filter(F.length("sig") >= 3)
    forms = rows.groupBy("bib_id", "sig", "spelling").agg(F.min("ord").alias("first"))
    heads = forms.groupBy("bib_id", "sig").agg(F.max_by("spelling", F.struct(F.length("spelling"), -F.col("first"))).alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    off = rows.join(heads, ["bib_id", "sig"]).filter("spelling <> canonical")
    return as_problems(off, "venues", problem("inconsistent_venue", "info", "this venue is written differently elsewhere in the bibliography", field="venue", local=F.col("spelling"), authoritative=F.col("canonical")))


def inconsistent_authors(people: DataFrame) -> DataFrame:
    """Findings for the rarer form of a name that occurs both in full and as initials; ``people`` has bib_id, ord and names.

    On equal counts the form that came first is reported.
    """
    names = people.select("bib_id", "ord", F.posexplode("names").alias("pos", "p")).filter("p.family_key <> '' and p.given <> ''")
    rows = names.select("bib_id", "ord", "pos", F.col("p.family_key").alias("family"), F.concat_ws(":", "p.family_key", "p.given_initial").alias("who"), F.when(initials_only(F.col("p.given")), "initials").otherwise("full").alias("form"))
    forms = rows.groupBy("bib_id", "who", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    rare = forms.groupBy("bib_id", "who").agg(F.min_by("form", F.struct("n", "first")).alias("form"), F.count(F.lit(1)).alias("k"), F.min("first").alias("start")).filter("k > 1").drop("k")
    off = rows.join(rare, ["bib_id", "who", "form"]).groupBy("bib_id", "ord", "who", "family", "form").agg(F.min("start").alias("start"))
    kind = F.when(F.col("form") == "initials", "initials").otherwise("a full name")
    message = F.concat(F.lit("author '"), "family", F.lit("' is given as "), kind, F.lit(" here and the other way elsewhere"))
    return as_problems(off, "authors", problem("inconsistent_author", "info", message, field="author"), F.col("start.ord") * 1000 + F.col("start.pos"))


# Fixed names of citation commands: a beginning, "cite", and an ending of each list.
BEGINNINGS = ("", "no", "full", "foot", "text", "paren", "auto", "super", "smart", "cite")
ENDINGS = ("", "p", "t", "s", "author", "year", "title", "url", "num", "par")
# Any command with its optional arguments and one group without groups in it.
COMMAND = r"\\([A-Za-z]+\*?(?:\s*\[[^\]]*\])*\s*\{[^{}]*)\}"
# A key in Markdown begins with a letter, digit or underscore; single punctuation may stand between such characters.
KEY = r"[\p{L}\p{Nd}_]"
AT = rf"(?<![\p{{L}}\p{{Nd}}_@])@({KEY}(?:{KEY}|[:.#$%&+?<>~/-](?={KEY}))*)"
COMMENT = r"(?m)(?<!\\)%.*$"
CITE_ALL = r"\\nocite\s*\{\s*\*\s*\}"


def citation_keys(text: Column, comments: bool = False) -> Column:
    """All keys that a manuscript cites, sorted; commented-out text counts only with ``comments``."""
    body = text if comments else F.regexp_replace(text, COMMENT, "")
    known = [f"{a}cite{al}{z}" for a in BEGINNINGS for al in ("", "al") for z in ENDINGS]
    cites = F.filter(F.regexp_extract_all(body, F.lit(COMMAND), 1), lambda x: F.lower(F.regexp_extract(x, "^[A-Za-z]+", 0)).isin(known))
    tex = F.flatten(F.transform(cites, lambda x: F.split(F.substring_index(x, "{", -1), ",")))
    tex = F.filter(F.transform(tex, stripped), lambda k: (k != "") & (k != "*"))
    return F.array_sort(F.array_distinct(F.concat(tex, F.regexp_extract_all(body, F.lit(AT), 1))))


def cites_all(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "").rlike(CITE_ALL)


def uncited(entries: DataFrame, cited: DataFrame, all_cited: DataFrame | None = None) -> DataFrame:
    """Entries (bib_id, ord, key) that no row of ``cited`` (bib_id, key) names, but in bibliographies of ``all_cited`` (bib_id)."""
    rest = entries.select("bib_id", "ord", "key").join(cited.select("bib_id", "key").distinct(), ["bib_id", "key"], "left_anti")
    return rest if all_cited is None else rest.join(all_cited.select("bib_id").distinct(), "bib_id", "left_anti")


def undefined(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Cited keys (bib_id, key), each once, that no entry defines."""
    return cited.select("bib_id", "key").distinct().join(entries.select("bib_id", "key"), ["bib_id", "key"], "left_anti")


def crosscheck(entries: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """(bib_id, uncited, undefined) for each of ``manuscripts`` (bib_id, text): keys in bibliography order, and sorted keys."""
    cited = manuscripts.select("bib_id", F.explode(citation_keys(F.col("text"))).alias("key"))
    covered = entries.join(manuscripts.select("bib_id").distinct(), "bib_id", "left_semi")
    rest = uncited(covered, cited, manuscripts.filter(cites_all(F.col("text"))))
    left = rest.groupBy("bib_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"]).alias("uncited"))
    right = undefined(entries, cited).groupBy("bib_id").agg(F.array_sort(F.collect_list("key")).alias("undefined"))
    empty = F.array().cast("array<string>")
    return manuscripts.select("bib_id").distinct().join(left, "bib_id", "left").join(right, "bib_id", "left").select("bib_id", F.coalesce("uncited", empty).alias("uncited"), F.coalesce("undefined", empty).alias("undefined"))


def uncited_problems(entries: DataFrame, manuscripts: DataFrame) -> DataFrame:
    cited = manuscripts.select("bib_id", F.explode(citation_keys(F.col("text"))).alias("key"))
    covered = entries.join(manuscripts.select("bib_id").distinct(), "bib_id", "left_semi")
    rows = uncited(covered, cited, manuscripts.filter(cites_all(F.col("text"))))
    return as_problems(rows, "uncited", problem("uncited_entry", "info", "this entry is never cited in the manuscript", local=F.col("key")))


VENUE_NAMES = ("journal", "journaltitle", "booktitle")


def bibliography_problems(entries: DataFrame) -> DataFrame:
    """Venue and author findings of entries with facts."""
    raw = field_of(F.col("fields"))
    venue = F.coalesce(*[present(raw(n)) for n in VENUE_NAMES])
    spelled = entries.select("bib_id", "ord", unicode_text(venue).alias("spelling"), venue_keys(venue).alias("venue_key")).filter("spelling is not null")
    named = entries.select("bib_id", "ord", people(present(raw("author"))).alias("names"))
    return inconsistent_venues(spelled).unionByName(inconsistent_authors(named))
