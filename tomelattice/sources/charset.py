"""Bytes of unknown charset decoded strictly."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Charsets in the order in which they are tried; the last one reads anything.
CANDIDATES = ("UTF-8", "GBK", "ISO-8859-1")
_MARKS = ((codecs.BOM_UTF16_BE, "UTF-16BE"), (codecs.BOM_UTF16_LE, "UTF-16LE"))


def _reads(data: bytes, charset: str, cut: bool) -> bool:
    decoder = codecs.getincrementaldecoder(charset)("strict")
    try:
        decoder.decode(data, final=not cut)
    except UnicodeDecodeError:
        return False
    return True


def detect(data: bytes, cut: bool = False) -> str:
    """The charset of some bytes: by a UTF-16 byte order mark, else the first candidate that decodes them strictly.

    cut says that the bytes may end within a character.
    """
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    return next(c for c in CANDIDATES if _reads(data, c, cut))


def decode(data: bytes, charset: str | None = None) -> tuple[str, str]:
    """(text, charset): decoded strictly as the given or detected charset, else as the first candidate that fits; a byte order mark stays."""
    for c in dict.fromkeys([*([charset] if charset else [detect(data)]), *CANDIDATES]):
        try:
            return data.decode(c), c
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1"), "ISO-8859-1"


@F.pandas_udf(T.StringType())
def detected(data: pd.Series) -> pd.Series:
    """The charset of a binary column; null for null."""
    return data.map(lambda b: None if b is None else detect(bytes(b)))


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("charset", T.StringType()))
def decoded(data: pd.Series) -> pd.DataFrame:
    """Text and charset of a binary column; nulls for null."""
    return pd.DataFrame([(None, None) if b is None else decode(bytes(b)) for b in data], columns=["text", "charset"])
