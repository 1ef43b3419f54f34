"""Normalisation of names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms of ingredient names, and the form of a concept code.
SYNONYMS = {
    "paracetamol": "acetaminophen",
    "paracetamol acetaminophen": "acetaminophen",
}
CONCEPT_CODE = r"^(?:UMLS:)?(C\d{7})$"
LOCAL_PREFIX = "DRUGCENTRAL:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def term(c: Column | str) -> Column:
    """Lower case, anything but a-z and 0-9 as single spaces, trimmed; null stays null. Idempotent."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


#: What a trim takes: white space of ASCII and Unicode, and the byte order mark.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def by_locale(c: Column | str) -> list[Column]:
    """Sort keys: the order of a dictionary (a before B, e before é before f), then that of code points as a tie."""
    return [F.collate(col(c), "UNICODE").asc(), col(c).asc()]


def collapsed(c: Column | str) -> Column:
    """White space of any kind as single spaces, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def query_text(c: Column | str) -> Column:
    return F.lower(collapsed(c))


def generic_name(salt: Column | str) -> Column:
    """A composition without bracketed parts and with one space around each +."""
    bare = F.regexp_replace(col(salt), r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s*\+\s*", " + "), r"\s+", " "))


def ingredient_terms(c: Column | str, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The distinct terms of a combination parted by + or /, synonyms replaced, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[+/]"), term), lambda t: t != "")
    if not synonyms:
        return F.array_distinct(parts)
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.array_distinct(F.transform(parts, lambda t: F.coalesce(known[t], t)))


def concept_code(c: Column | str) -> Column:
    """C and seven digits, with or without its prefix; null for anything else."""
    return F.nullif(F.regexp_extract(F.upper(trimmed(c)), CONCEPT_CODE, 1), F.lit(""))


def local_code(c: Column | str) -> Column:
    return F.when(trimmed(c).startswith(LOCAL_PREFIX), trimmed(c))


def identity(concept: Column | str, version: Column | str, disease: Column | str) -> Column:
    """The concept's identity, or else one made of version and normalised disease."""
    own = F.concat(F.lit(LOCAL_PREFIX), col(version), F.lit(":"), term(disease))
    return F.when(first_filled(concept).isNotNull(), F.concat(F.lit("UMLS:"), col(concept))).otherwise(own)


def dump_value(c: Column | str) -> Column:
    r"""A value of a database dump: \N and empty are null."""
    return F.nullif(F.nullif(col(c), F.lit("\\N")), F.lit(""))


def evidence(*parts: Column | str) -> Column:
    return F.concat_ws(" | ", *[first_filled(p) for p in parts])
