"""Column helpers with byte-wise case and white space rules, and the registry of tokenizers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import MARKUP

# Words that TFIDF leaves out unless STOPWORDS=NONE.
STOPWORDS = tuple("a an and are as at be but by for from has have he her his i in is it its of on or she that the their they to was were with you".split())

_EDGE = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def ascii_lower(c: Column) -> Column:
    """A-Z only: the collation of the language is bytes."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_literal(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def split_ws(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(ascii_lower(c), F.lit(lower_literal(needle)))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, MARKUP, "")


def tokenize(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(ascii_lower(c), F.lit("[A-Za-z0-9_]+"), F.lit(0))


_TOKENIZERS: dict[str, Callable[[str], list[str]]] = {}


def register_tokenizer(language: str, tokenizer: Callable[[str], list[str]]) -> None:
    """Use ``tokenizer(text) -> tokens`` for a language; it runs in Arrow batches on the executors."""
    _TOKENIZERS[language.lower()] = tokenizer


def tokens_of(c: Column, language: str | None = None) -> Column:
    if not language or language.lower() in ("default", "en") and language.lower() not in _TOKENIZERS:
        return tokenize(c)
    try:
        split = _TOKENIZERS[language.lower()]
    except KeyError:
        raise ValueError(f"no tokenizer is registered for {language!r}") from None
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else list(split(x)))

    return F.pandas_udf(apply, "array<string>")(c)
