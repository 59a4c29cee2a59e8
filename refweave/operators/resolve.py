"""Entries joined to the works they cite: by DOI, else by title, then on to the published version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refweave.functions.latex import title_keys
from refweave.functions.similarity import author_score, confidence, dice, similarity, tokens, year_score
from refweave.operators.project import FACTS

ACCEPT = 0.65  # fixed: a candidate that scores lower is no match
ROWS = 5  # fixed: titles that a search gives at most
SHARE = 0.4  # words of both titles that a search hit has in common at least (Dice)

FLAGS = ("retracted", "withdrawn", "expression_of_concern", "update_notices", "published_version_doi")


def as_records(works: DataFrame) -> DataFrame:
    """(doi, known struct): one row per DOI, the smallest record where several claim it."""
    keep = [c for c in (*FACTS, *FLAGS) if c in works.columns]
    return works.filter("doi is not null").select("doi", F.struct(*keep).alias("known")).groupBy("doi").agg(F.min("known").alias("known"))


def by_doi(entries: DataFrame, works: DataFrame) -> DataFrame:
    """Entries with a DOI, each with ``known`` and ``outcome``. The engine picks broadcast or shuffle by the works' size."""
    out = entries.filter("doi is not null").join(as_records(works), "doi", "left")
    return out.select(*entries.columns, "known", F.when(F.col("known").isNotNull(), "found").otherwise("not_found").alias("outcome"), F.when(F.col("known").isNotNull(), 1.0).alias("confidence"), F.lit(None).cast("string").alias("detail"))


def _meeting_places(keys: DataFrame, name: str, often: DataFrame, share: float, asks: bool, few: int, long: int) -> DataFrame:
    """(``name``, at): hashes at which a key meets every partner of the other side with a word share of ``share`` or more, and few others.

    Words go by how many keys of ``there`` have them, the rarest first. Keys of n
    and m words with such a share have at least o = share * (n + m) / 2 words in
    common, so the first k of these are among the first n - o + k words of the
    one and m - o + k of the other. If the first of them is in ``few`` keys at
    most, they meet in it; else all are frequent, and they meet in the first two,
    or in that one where o is 1. Keys of more than ``long`` words would have too
    many pairs of words and meet in one word, whatever it is.
    """
    need = share / (2 - share)
    words = keys.select(F.col(name), F.explode(tokens(F.col(name))).alias("word"))
    # Words that no other side has come first: they cost nothing and use up the prefix.
    ranked = words.join(often, "word", "left").groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ws"))
    n = F.size("ws")
    least = F.ceil(n * F.lit(need) - 1e-9).cast("int")
    common = lambda m: F.ceil((n + m) * F.lit(share / 2) - 1e-9).cast("int")
    first = lambda k: F.filter(F.slice("ws", F.lit(1), F.greatest(k, F.lit(0))), lambda w: w["n"] > 0)
    rare, frequent = (lambda w: w["n"] <= few), (lambda w: w["n"] > few)
    cut = ranked.select(
        name, n.alias("size"), least.alias("least"),
        F.when(n <= long, F.filter(first(n - common(least) + 1), rare)).alias("rare"),
        F.when(n <= long, F.filter(first(n - F.greatest(common(least), F.lit(2)) + 2), frequent)).alias("two"),
        F.when(n + 1 <= F.lit(2 / share + 1e-9), F.filter("ws", frequent)).alias("one"),
        F.when(n > long * need - 1e-9, first(n - common(F.greatest(least, F.lit(long + 1))) + 1)).alias("far"),
        F.when((n > long) & (least <= long), first(n - common(least) + 1)).alias("near"),
    )
    size, none = F.col("size"), F.array().cast("array<bigint>")
    met = lambda c, *tag: F.transform(c, lambda w: F.xxhash64(*tag, w["word"]))
    pairs = F.flatten(F.transform("two", lambda x, i: F.transform(F.slice("two", i + 2, F.size("two")), lambda y: F.xxhash64(F.lit("two"), x["word"], y["word"]))))
    # Where one word is enough, the sizes of both are part of the place: keys that need two do not come there.
    others = F.filter(F.sequence(F.lit(1), F.lit(max(1, int(2 / share + 1e-9)))), lambda m: (m + size <= F.lit(2 / share + 1e-9)) & (m >= F.col("least")) & (m * F.lit(need) - 1e-9 <= size))
    sizes = lambda m: (size, m) if asks else (m, size)
    single = F.flatten(F.transform(others, lambda m: met(F.col("one"), F.lit("one"), *sizes(m))))
    long_q, long_t = ("long", "short") if asks else ("short", "long")
    # A place of long keys is named by the kinds of both: what asks first, what is there second.
    kinds = lambda own, other: (F.lit(own), F.lit(other)) if asks else (F.lit(other), F.lit(own))
    far = F.when(size > long, met(F.col("far"), *kinds("long", "long"))).otherwise(met(F.col("far"), *kinds("short", "long")))
    near = met(F.col("near"), *kinds("long", "short"))
    parts = [F.coalesce(c, none) for c in (met(F.col("rare"), F.lit("rare")), pairs, single, far, near)]
    return cut.select(name, F.explode(F.array_distinct(F.concat(*parts))).alias("at"))


def similar_keys(asked: DataFrame, there: DataFrame, share: float = SHARE, few: int = 32, long: int = 48) -> DataFrame:
    """(q, t, share): all pairs of keys of ``asked`` (q) and ``there`` (t), each distinct, with a word share of ``share`` or more.

    Exact: all such pairs meet (see ``_meeting_places``), and all that meet are
    compared. ``few`` and ``long`` change how many meet, not the result.
    """
    often = there.select(F.explode(tokens(F.col("t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    left, right = _meeting_places(asked, "q", often, share, True, few, long), _meeting_places(there, "t", often, share, False, few, long)
    # Dealt by q alone, which serves the choice of the best of each q as well.
    met = left.join(right, "at").select("q", "t").repartition("q").distinct()
    return met.withColumn("share", dice(F.col("q"), F.col("t"))).filter(F.col("share") >= share)


def candidates(entries: DataFrame, works: DataFrame, rows: int = ROWS, share: float = SHARE) -> DataFrame:
    """(bib_id, ord, pos, known): for each entry the works of the ``rows`` titles that share the most words with its own.

    Ties go by the title keys, and works of one title have one place. A search is made once for each distinct title, over distinct titles. Works
    that agree in title key, people and year score alike, and the smallest record
    stands for them, so copies on either side never join many to many.
    """
    keep = [c for c in (*FACTS, *FLAGS) if c in works.columns]
    keyed = works.filter("title is not null").select(F.struct(*keep).alias("known"), title_keys("title").alias("t")).filter("t <> ''")
    people = F.transform("known.authors", lambda p: p["family_key"])
    records = keyed.groupBy("t", people.alias("people"), F.col("known.year").alias("year")).agg(F.min("known").alias("known"))
    asked = entries.filter("title_key is not null").select(F.col("title_key").alias("q"))
    pairs = similar_keys(asked.distinct(), keyed.select("t").distinct(), share)
    best = Window.partitionBy("q").orderBy(F.desc("share"), "t")
    kept = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= rows).select("q", "t", (F.col("place") - 1).alias("pos"))
    found = kept.join(records.select("t", "known"), "t").select("q", "pos", "known")
    return entries.select("bib_id", "ord", F.col("title_key").alias("q")).join(found, "q").select("bib_id", "ord", "pos", "known")


def best_match(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with the best of ``found`` (bib_id, ord, pos, known): the first of the highest score, if that is accepted.

    Among equal scores and places the smallest record wins, so reruns agree.
    """
    keyed = found.withColumn("_k", title_keys("known.title")).join(entries.select("bib_id", "ord", "title_key", "authors", "year"), ["bib_id", "ord"])
    title = F.when(F.col("title_key").isNotNull() & F.col("known.title").isNotNull(), similarity(F.col("title_key"), F.col("_k")))
    score = F.coalesce(confidence(title, author_score(F.col("authors"), F.col("known.authors")), year_score(F.col("year"), F.col("known.year"))), F.lit(0.0))
    scored = keyed.withColumn("score", score).groupBy("bib_id", "ord").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"), F.col("known").alias("k"))).alias("top"))
    out = entries.join(scored, ["bib_id", "ord"], "left")
    top = -F.col("top.s")
    accepted = F.coalesce(top >= ACCEPT, F.lit(False))
    detail = F.when(F.col("title").isNull(), None).when(top.isNull(), "no results").when(~accepted, F.concat(F.lit("no candidate scored above 0.65 (best was "), F.format_number(F.bround(top, 2), 2), F.lit(")")))
    return out.select(*entries.columns, F.when(accepted, F.col("top.k")).alias("known"), F.when(accepted, "found").otherwise("not_found").alias("outcome"), F.when(accepted, top).alias("confidence"), detail.alias("detail"))


def resolve(entries: DataFrame, works: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """``entries`` (with facts) with known, outcome, confidence, detail and ``published``, the record of the published version.

    Entries with a DOI never go by title. ``replies`` (bib_id, ord, pos, known)
    are recorded search results; without them candidates come from ``works``.
    """
    untied = entries.filter("doi is null")
    found = replies if replies is not None else candidates(untied, works)
    both = by_doi(entries, works).unionByName(best_match(untied, found))
    onward = as_records(works).select(F.col("doi").alias("_next"), F.col("known").alias("published"))
    return both.join(onward, F.col("known.published_version_doi") == F.col("_next"), "left").drop("_next")


# Fixed: the columns that a search asks the registry for.
SELECT = (
    "DOI,title,subtitle,author,issued,published,container-title,short-container-title,volume,issue,page,publisher,type,subtype,relation,"
    "update-to,updated-by,alternative-id"
)


def search_identifier(title, first_family):
    """The sorted, encoded parameters by which a search is recorded; no author, no author parameter."""
    part = lambda name, value: F.concat(F.lit(f"{name}="), F.url_encode(value))
    author = F.when(first_family.isNotNull(), part("query.author", first_family))
    return F.concat_ws("&", author, part("query.bibliographic", title), part("rows", F.lit(str(ROWS))), part("select", F.lit(SELECT)))


def recorded_replies(entries: DataFrame, responses: DataFrame) -> DataFrame:
    """(bib_id, ord, pos, known): recorded ``responses`` (identifier, body) to the searches of entries without a DOI.

    Each distinct search is joined once, however many entries ask it.
    """
    from refweave.sources.works import map_works, search_items

    asked = entries.filter("doi is null and title is not null").select("bib_id", "ord", search_identifier(F.col("title"), F.get("authors", F.lit(0))["family"]).alias("identifier"))
    wanted = responses.join(asked.select("identifier").distinct(), "identifier", "left_semi")
    mapped = map_works(search_items(wanted))
    return asked.join(mapped.select("identifier", "pos", F.struct(*FACTS, *FLAGS).alias("known")), "identifier").select("bib_id", "ord", "pos", "known")
