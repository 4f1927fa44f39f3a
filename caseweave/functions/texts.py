"""Text normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Case-insensitive substring match of any term."""
    lowered = F.lower(text)
    return reduce(
        lambda a, b: a | b, [lowered.contains(t.lower()) for t in terms], F.lit(False)
    )


def starts_with_any(code: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes], F.lit(False))


def has_token(text: Column, token: str) -> Column:
    """Whole-word match, so a short name does not hit inside a longer word."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " ")
    return F.array_contains(words, token.lower())


def label_match(text: Column, terms: Sequence[str], how: str = "contains") -> Column:
    """Match a label: ``contains``, ``exact`` (case-folded) or ``token``."""
    if how == "contains":
        return contains_any(text, terms)
    if how == "exact":
        return F.lower(text).isin([t.lower() for t in terms])
    if how == "token":
        return reduce(lambda a, b: a | b, [has_token(text, t) for t in terms], F.lit(False))
    raise ValueError(f"unknown match {how!r}")


def plain_code(code: Column) -> Column:
    """A diagnosis code without dots, upper-cased."""
    return F.upper(F.trim(F.regexp_replace(code, r"\.", "")))


def plain_prefix(prefix: str) -> str:
    return prefix.replace(".", "").strip().upper()


# Fixed pattern: a trailing strength and unit in a drug name.
STRENGTH = r"(?i)\s+\d+[\d.]*\s*(mg|g|ml|mcg|%|units?|meq).*$"
# Fixed pattern: a trailing remark in parentheses.
REMARK = r"\s*\(.*\)\s*$"


def plain_drug(name: Column) -> Column:
    """A drug name in lower case without trailing remark and strength."""
    lowered = F.trim(F.lower(name))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, REMARK, ""), STRENGTH, ""))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


# Fixed pattern: punctuation that is dropped from a phrase (hyphens stay).
PUNCTUATION = r"[.,;:!?()\[\]{}'\"`]"


def plain_phrase(phrase: Column) -> Column:
    """Lower case, punctuation other than hyphens dropped, spaces collapsed."""
    kept = F.regexp_replace(F.lower(phrase), PUNCTUATION, "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def specimen_term(term: str) -> str:
    """A culture term without the trailing word for the test itself."""
    words = term.split()
    if len(words) > 1 and words[-1].lower() in {"culture", "cultures", "cx"}:
        return " ".join(words[:-1])
    return term


def valid_concept_id(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^\d{5,18}$"), F.lit(False))
