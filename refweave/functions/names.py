"""Author names: a pandas UDF turns a field into structs that carry their comparison keys."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refweave.functions.latex import mapped, strip_accents, to_unicode

# Fixed word lists.
PARTICLES = frozenset({
    "van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "el", "al", "bin", "ibn", "ben", "ter", "ten", "af",
    "av", "zu", "vom", "op", "st",
})
SUFFIXES = frozenset({"jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "esq"})
OTHERS = frozenset({"others", "et al", "et al."})

PERSON = "struct<display:string,family:string,given:string,suffix:string,family_key:string,given_initial:string>"
PEOPLE = f"array<{PERSON}>"


_NOT_LETTERS = re.compile("[^a-z]+")


def person(display: str, family: str, given: str = "", suffix: str = "") -> dict:
    """A person with the keys that names are compared by: bare letters of the surname, first letter of the given name."""
    initial = re.search(r"[^\W\d_]", strip_accents(given))
    return {
        "display": display, "family": family, "given": given, "suffix": suffix,
        "family_key": _NOT_LETTERS.sub("", strip_accents(family).casefold()), "given_initial": initial[0].casefold() if initial else "",
    }


def split_people(field: str) -> list[str]:
    """The parts between the word "and" where no brace is open."""
    depth, cuts, last = 0, [], 0
    for token in re.finditer(r"[{}]|\s+and\s+", field, re.IGNORECASE):
        if token[0] == "{":
            depth += 1
        elif token[0] == "}":
            depth = max(0, depth - 1)
        elif depth == 0:
            cuts.append(field[last : token.start()])
            last = token.end()
    cuts.append(field[last:])
    return [c.strip() for c in cuts if c.strip()]


def _is(words: frozenset[str]) -> Callable[[str], bool]:
    return lambda word: word.rstrip(".").casefold() in words


_suffix, _particle = _is(SUFFIXES), _is(PARTICLES)

def _natural(text: str) -> tuple[str, str, str]:
    """(family, given, suffix) of words without commas."""
    words = text.split()
    if len(words) < 2:
        return (words or [text])[0], "", ""
    # A letter a word: s a suffix, p a particle, w any other. The particles right before the last word belong to the surname.
    kinds = "".join("s" if _suffix(w) else "p" if _particle(w) else "w" for w in words)
    end = len(words) - (kinds[-1] == "s" and len(words) > 2)
    family = 1 + len(kinds[1 : end - 1].rstrip("p")) if end > 1 else 0
    return " ".join(words[family:end]), " ".join(words[:family]), " ".join(words[end:])


def parse_person(value: str) -> dict:
    """One name: a group of its own, "Family, Given", "Family, Suffix, Given", or in natural order, with a suffix behind a comma or not."""
    shown = to_unicode(value)
    if re.fullmatch(r"\s*\{[^{]*\}\s*", value):
        return person(shown, shown)
    head, *rest = (part.strip() for part in shown.split(","))
    suffix = rest[0] if rest and _suffix(rest[0]) else ""
    if not rest or rest == [suffix] and suffix:
        family, given, behind = _natural(head)
        return person(shown, family, given, suffix or behind)
    return person(shown, head, rest[-1], suffix if len(rest) > 1 else "")


def parse_people(field: str) -> list[dict]:
    """The people of a field, in order; "and others" names nobody."""
    named = (parse_person(part) for part in split_people(field) if to_unicode(part).casefold() not in OTHERS)
    return [p for p in named if p["display"]]


people = mapped(parse_people, PEOPLE)


def one_person(column: Column | str) -> Column:
    return F.get(mapped(lambda v: [parse_person(v)], PEOPLE)(column), F.lit(0))



def display_people(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda p: p["display"]), " and ")


def same_person(left: Column, right: Column) -> Column:
    initials = (left["given_initial"] == "") | (right["given_initial"] == "") | (left["given_initial"] == right["given_initial"])
    return (left["family_key"] == right["family_key"]) & initials


def people_match(local: Column, known: Column) -> Column:
    """Whether a list names the first people of another in order; false if either is empty."""
    pairs = F.zip_with(local, F.slice(known, F.lit(1), F.size(local)), lambda a, b: same_person(a, b))
    return (F.size(local) > 0) & (F.size(known) > 0) & (F.size(local) <= F.size(known)) & F.forall(pairs, lambda x: x)


def people_match_unordered(local: list[dict], known: list[dict]) -> bool:
    """As ``people_match``, in any order: each local person is given one of the known people that fit, the first that is free."""
    free = dict(enumerate(known))
    for a in local:
        fits = [k for k, b in free.items() if a["family_key"] == b["family_key"] and len({a["given_initial"], b["given_initial"]} - {""}) < 2]
        if not fits:
            return False
        del free[fits[0]]
    return 0 < len(local) <= len(known)


def initials_only(given: Column) -> Column:
    """Whether a given name is written as single letters, parted by spaces or periods."""
    parts = F.filter(F.split(given, r"(?U)[\s.]+"), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: F.length(x) == 1)
