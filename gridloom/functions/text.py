"""Functions on names and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Canonical decomposition without what is not ASCII then; null stays null."""
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode())


def has_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    """Last extension with its dot, in lower case, or ''."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def before_last_dash(name: Column) -> Column:
    return F.regexp_replace(name, "-[^-]*$", "")


def last_part(name: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(name, sep), -1)


def zero_pad(i: Column, width: int = 3) -> Column:
    """Zeros in front up to the width; longer numbers stay whole."""
    s = i.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
