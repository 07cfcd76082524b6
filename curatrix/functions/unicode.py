"""The few rules that Spark has no function for, as vectorised functions: Unicode normal forms, numeric entities,
and resolving relative addresses. Meant to run once, when records are cleaned."""

from __future__ import annotations

import html
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@pandas_udf(StringType())
def without_marks(x: pd.Series) -> pd.Series:
    """Compatibility form without combining marks."""
    return x.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


@pandas_udf(StringType())
def without_diacritics(x: pd.Series) -> pd.Series:
    """Canonical form without the combining marks of U+0300 to U+036F; composed characters of other scripts stay apart."""
    return x.map(lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not "\u0300" <= c <= "\u036f"), na_action="ignore")


@pandas_udf(StringType())
def lookup_text(x: pd.Series) -> pd.Series:
    """For finding names: compatibility form, lower case, without marks, punctuation, symbols and white space."""

    def plain(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c)[0] not in "MPSZ" and not c.isspace()).lower()

    return x.map(plain, na_action="ignore")


@pandas_udf(StringType())
def decode_entities(x: pd.Series) -> pd.Series:
    """Named, decimal and hexadecimal entities."""
    return x.map(html.unescape, na_action="ignore")


@pandas_udf(StringType())
def absolute_url(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else urljoin(b or "", u) for u, b in zip(url, base, strict=True)])
