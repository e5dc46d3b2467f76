"""Text expressions; JVM-side but for case folding, compatibility forms and nested JSON, which Spark lacks."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no term.
STOP_WORDS = ("本文", "研究", "结果", "方法", "进行", "分析", "通过", "不同", "相关", "影响", "the", "and", "with", "from", "that", "this", "were", "was", "for", "using")


def strip(c: Column) -> Column:
    """Without white space at either end (trim drops only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    """White space collapsed and stripped, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def unit_token(c: Column) -> Column:
    """A unit's comparable form: no white space, lower case, one spelling of the degree sign."""
    return F.replace(F.lower(F.regexp_replace(c, r"\s+", "")), F.lit("℃"), F.lit("°c"))


@F.pandas_udf(StringType())
def casefolded(texts: pd.Series) -> pd.Series:
    """Full case folding, which joins what lower case keeps apart (ß and ss)."""
    return texts.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """The compatibility composition (NFKC) of texts."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def slug(c: Column, most: int = 80) -> Column:
    """Compatibility form, lower case, runs of non-word characters as one hyphen, none (nor underscores) at the ends, cut."""
    ends = r"^[-_]+|[-_]+$"
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(strip(compatible(c))), r"[^\p{L}\p{N}_]+", "-"), ends, ""), 1, most), r"[-_]+$", "")


def authors(c: Column) -> Column:
    """The names of an author line."""
    return F.filter(F.transform(F.split(c, "[;,，；]"), strip), lambda n: n != "")


def cut(c: Column, most: int) -> Column:
    """A text for a column of limited width."""
    return F.substring(c, 1, most)


def clamped(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def merged_maps(old: Column, new: Column) -> Column:
    """old with new's keys put over it; null counts as empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def tokens(c: Column, least: int = 2) -> Column:
    """Lower-case letter runs of some length that are no stop words, in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)")), lambda w: (F.char_length(w) >= least) & ~w.isin(*STOP_WORDS))


def missing_as(c: Column, marker: str = "——") -> Column:
    """Falsy values (null, empty) as the marker."""
    return F.when(c.isNull() | (c == ""), marker).otherwise(c)


def first_key(c: Column, *keys: str) -> Column:
    """The first non-empty value of some keys of a JSON object."""
    return F.coalesce(*(F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")) for k in keys))


def joined(sep: str, *parts: Column) -> Column:
    """Parts with a separator between; null and blank parts are skipped."""
    return F.concat_ws(sep, *(F.nullif(strip(p), F.lit("")) for p in parts))


#: What must not stand in a text file.
SECRETS = {
    "database_password": r"(?i)DB_PASSWORD\s*=\s*(?!change-me|$).+",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "hardcoded_windows_workspace": r"[A-Za-z]:\\Users\\[^\\]+\\Desktop",
}
#: Parts of the names of settings that are secret.
SENSITIVE = ("secret", "password", "token", "api_key", "apikey", "credential", "authorization", "private_key")


def secrets(c: Column, patterns: dict[str, str] = SECRETS) -> Column:
    """Sorted names of the patterns found."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in patterns.items()))))


def redacted(c: Column, names: tuple[str, ...] = SENSITIVE) -> Column:
    """A map with the values of sensitive keys masked."""
    return F.transform_values(c, lambda k, v: F.when(F.replace(F.lower(k), F.lit("-"), F.lit("_")).rlike("|".join(names)), F.lit("***")).otherwise(v))


def _masked(value):
    if isinstance(value, dict):
        return {k: "***" if any(n in k.casefold().replace("-", "_") for n in SENSITIVE) else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


def _over_json(f):
    """A function of a JSON text's value as a function of columns; null for what is no JSON."""

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(f(json.loads(t)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return apply


#: A JSON text with the values of sensitive names masked at every depth; keys sorted.
redacted_json = _over_json(_masked)
#: A JSON text in one form: keys sorted at every depth, no blanks.
canonical_json = _over_json(lambda v: v)
