"""Columns for names, labels, urls, JSON and hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def artists(name: Column) -> Column:
    """'A & B ft. C - Title' -> [A, B]: left of ' - ', without ' ft. ', split at '&'."""
    left = F.substring_index(F.substring_index(name, " - ", 1), " ft. ", 1)
    return F.filter(F.transform(F.split(left, "&"), lambda a: F.trim(a)), lambda a: a != "")


def performers(name: Column) -> Column:
    """Names split at B2B, & and vs, lower-cased, each once, of two letters at least."""
    parts = F.split(F.lower(name), r"\s+(?:b2b|&|vs\.?)\s+")
    return F.array_distinct(F.filter(F.transform(parts, lambda a: F.trim(a)), lambda p: F.length(p) >= 2))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern that is found, in the order given."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def axis_key(version: Column, stem: Column, variant: Column) -> Column:
    """Three axes as one key, 'a__b__c', each trimmed and lower-cased, 'regular' where empty."""
    one = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("regular"))
    return F.concat_ws("__", one(version), one(stem), one(variant))


def axis_parts(key: Column) -> Column:
    parts = F.split(key, "__")
    return F.struct(F.get(parts, F.lit(0)).alias("version"), F.get(parts, F.lit(1)).alias("stem"), F.get(parts, F.lit(2)).alias("variant"))


def plain_label(label: Column) -> Column:
    """'006w2' -> '6w2'."""
    return F.regexp_replace(label, r"^0+(?=\d)", "")


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, put right where it shows the marks of that and the repair is valid."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    return F.when(text.rlike("[ÂÃ][\u0080-¿]"), again).otherwise(text)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def canonical_hash(**values: Column) -> Column:
    """SHA-256 of the values as JSON with sorted keys; nulls are written."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(v)), F.lit("null"))) for k, v in sorted(values.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def trimmed_list(text: Column) -> Column:
    """A comma list as an array of trimmed entries that aren't empty."""
    return F.filter(F.transform(F.split(text, ","), lambda a: F.trim(a)), lambda x: x != "")


@F.pandas_udf(StringType())
def folded(words: pd.Series) -> pd.Series:
    """Words in compatibility decomposition without their combining marks; meant for distinct words."""
    return words.map(lambda w: None if w is None else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)))


def unwrapped(url: Column, names: Sequence[str], depth: int = 3) -> Column:
    """The address in the first of these query parameters, decoded, up to `depth` times; as it is where there is none or what is there is no address."""
    for _ in range(depth):
        inner = F.try_url_decode(F.regexp_extract(url, r"[?&](?:" + "|".join(names) + r")=([^&#]+)", 1))
        url = F.when(inner.rlike(r"^[a-z][a-z0-9+.-]*://"), inner).otherwise(url)
    return url


# The words that tell a version, in order of precedence.
VERSIONS = ((" mashup| vs | vs\\. ", "Mashup"), (" bootleg", "Bootleg"), (" rework", "Rework"), (" remix", "Remix"), (" edit", "Edit"), (" flip| vip", "AltVersion"))


def version_tag(title: Column, remix: Column) -> Column:
    """The version that a title claims, the first of VERSIONS that it names; without one, AltVersion if it is marked as a remix, else null."""
    return F.coalesce(first_match(F.lower(title), VERSIONS), F.when(remix, "AltVersion"))


def is_remixish(title: Column, remix: Column) -> Column:
    """Whether a title is marked as a remix or names a rework, remix, mashup or bootleg."""
    return F.coalesce(remix, F.lit(False)) | F.coalesce(F.lower(title).rlike(r" rework| remix| mashup| vs | vs\. | bootleg"), F.lit(False))


def variant(title: Column) -> Column:
    """extended for an extended mix, version or edit, else regular."""
    return F.when(F.lower(title).rlike(r"\bextended\s+(?:mix|version|edit)\b|\(extended\)"), "extended").otherwise("regular")
