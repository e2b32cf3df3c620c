"""Splitting a URL into its ordered terms, as one Column expression.

The terms of a URL are its host labels without the last two, then its path terms, then, if the query has any term, a
``?`` marker followed by the query terms. Everything is built-in and JVM-side, so the expression stays inside code
generation and reads only the URL column.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The URL schemes whose last path segment may carry ";parameters" (none, then those of RFC 1808 and
# its successors as the Python standard library lists them).
SCHEMES_WITH_PARAMETERS = [
    "", "ftp", "hdl", "prospero", "http", "https", "imap", "shttp",
    "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]

# Leading blanks and control characters are cut; tabs and line breaks are removed anywhere.
_CLEAN_UP = r"^[\x00-\x20]+|[\t\r\n]+"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^//([^/]*)"
_LAST_SEGMENT_PARAMETERS = r";[^/]*\z"
_PATH_SEPARATORS = r"[/\- +]"
_QUERY_SEPARATORS = r"[&=]"

TermSorter = Callable[[Column], Column]


def _without_fragment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, _CLEAN_UP, ""), "#", 1)


def _before_query(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(_without_fragment(url), _SCHEME, ""), "?", 1)


def host_terms(url: Column) -> Column:
    """Labels of the host, user information included, without the last two."""
    labels = F.split(F.regexp_extract(_before_query(url), _NETLOC, 1), r"\.")
    return F.array_remove(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), "")


def path_terms(url: Column) -> Column:
    """Terms of the path, cut at slash, hyphen, blank and plus sign."""
    path = F.regexp_replace(_before_query(url), _NETLOC, "")
    scheme = F.lower(F.regexp_extract(_without_fragment(url), _SCHEME, 1))
    # The inner test is reached only by the rare path that has a semicolon.
    has_parameters = F.contains(path, F.lit(";")) & scheme.isin(SCHEMES_WITH_PARAMETERS)
    path = F.when(has_parameters, F.regexp_replace(path, _LAST_SEGMENT_PARAMETERS, "")).otherwise(path)
    return F.array_remove(F.split(path, _PATH_SEPARATORS), "")


def query_terms(url: Column) -> Column:
    """Names and values of the query behind a ``?`` marker; empty if the query holds no term."""
    without_scheme = F.regexp_replace(_without_fragment(url), _SCHEME, "")
    query = F.substr(without_scheme, F.length(_before_query(url)) + 2)
    marker = F.when(F.translate(query, "&=", "") != "", "?").otherwise("")
    return F.array_remove(F.concat(F.array(marker), F.split(query, _QUERY_SEPARATORS)), "")


def split_url(url: Column, term_sorter: TermSorter | None = None) -> Column:
    """Ordered terms of ``url`` as ``array<string>``; null for a null URL.

    :param term_sorter: reorders the finished array, e.g. ``F.array_sort`` or ``F.reverse``. Wrap a plain Python
        function with :func:`python_sorter`.
    """
    terms = F.concat(host_terms(url), path_terms(url), query_terms(url))
    return terms if term_sorter is None else term_sorter(terms)


def python_sorter(sort_terms: Callable[[list[str]], list[str]]) -> TermSorter:
    """Make a term sorter of a Python function over lists. It runs in Arrow batches in Python workers, so prefer a
    Column function where one exists."""

    @F.pandas_udf(ArrayType(StringType()))
    def sort_batch(batch: pd.Series) -> pd.Series:
        return batch.map(lambda terms: None if terms is None else list(sort_terms(list(terms))))

    return sort_batch
