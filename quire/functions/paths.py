"""Paths, URLs and output names."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quire.functions.text import sanitize_suffix, uni_trim


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(x: Column | str) -> Column:
    return F.regexp_extract(_col(x), "([^/]*)/*$", 1)


def dirname(x: Column | str) -> Column:
    found = F.regexp_extract(_col(x), "^(.*?)/+[^/]*$", 1)
    return F.when(found != "", found).otherwise(F.when(_col(x).startswith("/"), "/").otherwise("."))


def stem(x: Column | str) -> Column:
    """Base name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(x), "(?<=.)\\.[^.]*$", "")


def extension(x: Column | str) -> Column:
    return F.regexp_extract(basename(x), "(?<=.)(\\.[^.]*)$", 1)


def is_html(x: Column | str) -> Column:
    return F.lower(_col(x)).rlike("\\.(html|xhtml|htm)$")


def is_epub(x: Column | str) -> Column:
    """Whether an input path is accepted."""
    return F.lower(extension(uni_trim(x))) == ".epub"


def cut_href(x: Column | str) -> Column:
    """Without fragment and query."""
    return F.split_part(F.split_part(_col(x), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


#: What percent-decoding of whole references leaves alone.
RESERVED = frozenset("#$&+,/:;=?@")


def decode_full(href: str) -> str:
    """Percent-decoding that keeps the escapes of reserved characters; malformed text stays."""
    try:
        raw, out, at = href, bytearray(), 0
        while at < len(raw):
            code = raw[at : at + 3]
            if code[0] == "%":
                byte = unquote_to_bytes(code)
                if len(byte) != 1 or len(code) != 3:
                    return href
                out += code.encode() if chr(byte[0]) in RESERVED else byte
                at += 3
            else:
                out += raw[at].encode()
                at += 1
        return out.decode()
    except (UnicodeDecodeError, ValueError):
        return href


def resolve(directory: str, href: str) -> str:
    """Path of an archive member from the package's directory and a reference in it."""
    return posixpath.normpath(posixpath.join(directory or "", decode_full(href.split("#")[0].split("?")[0])))


@pandas_udf(T.StringType())
def resolve_href(directory: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else resolve(d, h) for d, h in zip(directory, href, strict=True)], dtype=object)


def base_url(x: Column | str) -> Column:
    """A provider's root with scheme and /v1, without a chat path."""
    t = uni_trim(x)
    t = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    t = F.regexp_replace(F.regexp_replace(t, "/+$", ""), "(?i)/chat/completions$", "")
    return F.when(uni_trim(x) == "", "").otherwise(F.when(F.lower(t).endswith("/v1"), t).otherwise(F.concat(t, F.lit("/v1"))))


def output_path(source: Column | str, directory: Column | str, suffix: Column | str) -> Column:
    """<directory>/<stem><suffix>.epub, with _out where that is the input itself."""
    start = F.concat(F.regexp_replace(_col(directory), "/+$", ""), F.lit("/"), stem(source), sanitize_suffix(suffix))
    return F.when(F.concat(start, F.lit(".epub")) == _col(source), F.concat(start, F.lit("_out.epub"))).otherwise(F.concat(start, F.lit(".epub")))
