"""Predicates, keys and forms of personal names; Column to Column, in the JVM."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles of surnames, and short forms of first names.
PARTICLES = ("DE", "DEL", "DELLA", "DI", "DA", "DOS", "VAN", "VON", "LA", "LE", "EL", "AL", "BIN", "IBN", "TER", "TEN", "DU", "ST", "SAN", "MAC")
NICKNAMES = {
    "frederic": ("Fred", "Freddie", "Freddy"), "frederick": ("Fred", "Freddie", "Freddy"), "joshua": ("Josh",), "martin": ("Marty",), "matthew": ("Matt", "Matty"), "robert": ("Bob", "Bobby", "Rob", "Robbie"),
    "ron": ("Ronnie",), "ronald": ("Ron", "Ronnie"), "stephen": ("Steve", "Stevie"), "steven": ("Steve", "Stevie"), "walter": ("Walt", "Wally"),
}


def parts(name: Column) -> Column:
    return F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda t: t != "")


def initial_form(name: Column) -> Column:
    """The first token is a single letter, with or without a full stop."""
    return F.coalesce(F.get(parts(name), F.lit(0)).rlike(r"^[^A-Za-z]*[A-Za-z][^A-Za-z]*$"), F.lit(False))


def particle_only(name: Column) -> Column:
    """A particle and one more token."""
    first = F.regexp_replace(F.upper(F.get(parts(name), F.lit(0))), r"\.+$", "")
    return F.coalesce((F.size(parts(name)) == 2) & first.isin(*PARTICLES), F.lit(False))


def generic(name: Column, first: Collection[str], last: Collection[str]) -> Column:
    """A common first name with a common last name: too many people bear it."""
    p = F.transform(parts(name), lambda t: F.upper(t))
    return F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).isin(*first) & F.try_element_at(p, F.lit(-1)).isin(*last), F.lit(False))


def digit_key(name: Column) -> Column:
    """Letters and digits, upper-case: digits tell people apart."""
    return F.upper(F.regexp_replace(name, r"[^A-Za-z0-9]", ""))


def punct_key(name: Column) -> Column:
    """Letters alone, upper-case: spellings with and without full stops agree."""
    return F.upper(F.regexp_replace(name, r"[^A-Za-z]", ""))


def nickname_forms(name: Column, honorifics: Collection[str]) -> Column:
    """The whole name once with each short form of its first name; none if the first name has none.

    The first name is the first token of two letters or more that is no title.
    """
    tokens = parts(name)
    bare = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "^[.,;:'\"]+|[.,;:'\"]+$", "")))
    fit = F.transform(bare, lambda t: t.rlike(r"^[a-z]{2,}$") & ~F.upper(t).isin(*honorifics))
    at = F.array_position(fit, F.lit(True))
    table = F.create_map(*[x for k, forms in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, forms)))])
    forms = F.coalesce(F.try_element_at(table, F.try_element_at(bare, F.when(at > 0, at).cast("int"))), F.array().cast("array<string>"))
    return F.transform(forms, lambda nick: F.array_join(F.transform(tokens, lambda t, i: F.when(i + 1 == at, nick).otherwise(t)), " "))


def sentence_around(text: Column, pattern: str) -> Column:
    """The sentence that holds the pattern's first match, with single spaces; null without a match."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    return F.regexp_replace(F.trim(F.get(F.filter(sentences, lambda s: s.rlike(pattern)), F.lit(0))), r"\s+", " ")
