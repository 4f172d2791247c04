"""Label and document text functions, Column -> Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_text(text: Column) -> Column:
    """Lower case, hyphens tightened, blanks squeezed; null folds to the empty text."""
    return F.coalesce(squeeze(F.regexp_replace(F.lower(text), r"\s*-\s*", "-")), F.lit(""))


def fold_label(text: Column) -> Column:
    """Only letters a-z and digits remain."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def identifier(text: Column) -> Column:
    """Label to identifier: other characters become single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", "")


def any_of(phrases: list[str], whole: bool = False) -> str:
    """Pattern of texts that hold one of the phrases, in any case and spacing, from a word's start (whole: to its end)."""
    worded = ["\\s+".join(re.escape(w) for w in p.split()) for p in phrases]
    return rf"(?i)\b(?:{'|'.join(worded)})" + (r"\b" if whole else "")


def slug(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("-")), F.lit("&"), F.lit("and"))


def download_name(text: Column, ext: str = "pdf") -> Column:
    """File name a source is saved under."""
    return F.concat(F.replace(F.replace(text, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and")), F.lit("." + ext))


def canonical_entity(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """First matching rule wins: (kind, pattern, key), kind 'contains' or 'equals'.

    Text matching no rule (aggregates such as an industry total) gives null.
    """
    low = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for kind, pattern, key in reversed(rules):
        hit = low == pattern if kind == "equals" else low.contains(pattern)
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def visible_text(html: Column) -> Column:
    """Text a reader sees: scripts, styles, comments and tags removed."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(out, r"(?s)<[^>]*>", " ")


def plain_number(token: Column) -> Column:
    """A stated number without sign, separators, trailing points and trailing zeros after a point."""
    bare = F.regexp_replace(F.regexp_replace(token, "[-,]", ""), r"\.+$", "")
    return F.when(bare.rlike(r"^\d+\.\d+$"), F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.$", "")).otherwise(bare)


def stated_numbers(text: Column) -> Column:
    """Distinct numbers stated in a text, in plain form."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d[\d.,]*)"), F.lit(1)), plain_number))


def traceable_tokens(tokens: Column) -> Column:
    """Tokens of at least two digits: shorter ones are page numbers and list marks."""
    return F.filter(tokens, lambda t: F.length(F.regexp_replace(t, "[-.]", "")) >= 2)


def chart_numbers(script: Column) -> Column:
    """Numbers inside data:[...] arrays only, not labels or other settings."""
    arrays = F.regexp_extract_all(script, F.lit(r"\bdata\s*:\s*\[([^\]]*)\]"), F.lit(1))
    return F.array_distinct(
        F.flatten(F.transform(arrays, lambda a: F.regexp_extract_all(a, F.lit(r"(-?\d[\d.]*)"), F.lit(1))))
    )


def fingerprint(content: Column) -> Column:
    """sha256 and size of a content."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("size"))


def composite_fingerprint(*parts: Column) -> Column:
    """One hash over several inputs; nulls and lengths cannot make two inputs collide."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])), 256)
