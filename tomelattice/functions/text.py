"""Scalar text functions as columns.  Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the knowledge base's interfaces.
NAME_PATTERN, NAME_LENGTH = r"^[a-zA-Z0-9_-]+$", 50
FORBIDDEN_IN_NAMES = r'[\\/:*?"<>|]'
SIMILAR_AT, SIMILAR_LENGTH = 0.85, 500
SUMMARY_BUDGET, SUMMARY_HALF = 20_000, 10_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column | str) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space alone."""
    return col(c).isNull() | ~col(c).rlike(r"(?U)\S")


def normalized(c: Column | str) -> Column:
    """A keyword trimmed and in lower case; null for a blank one."""
    k = F.lower(trimmed(c))
    return F.when(k != "", k)


def truncated(c: Column | str, n: int) -> Column:
    """The first n characters; null stays null, n below 1 gives ''."""
    return F.when(col(c).isNotNull(), F.substring(col(c), 1, n) if n > 0 else F.lit(""))


def tokens(c: Column | str) -> Column:
    """The parts of a text between white space, normalized, in order and with repetitions."""
    return F.filter(F.split(F.lower(trimmed(c)), r"\s+"), lambda x: x != "")


def prompt_normalized(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein distance / the longer length; 1 for two empty strings, 0 if only one is."""
    a, b = col(a), col(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def threshold_or_default(t: float) -> float:
    return t if 0 <= t <= 1 else SIMILAR_AT  # not for NaN either


def similar(a: Column | str, b: Column | str, threshold: float = SIMILAR_AT, max_length: int = SIMILAR_LENGTH, enabled: bool = True) -> Column:
    """Whether two prompts count as the same: equal once normalized, or both short enough and alike enough; never with a null."""
    if not enabled:
        return F.lit(False)
    x, y = prompt_normalized(a), prompt_normalized(b)
    longest = max_length if max_length > 0 else SIMILAR_LENGTH
    short = (F.length(x) <= longest) & (F.length(y) <= longest)
    return F.coalesce((x == y) | (short & (similarity(x, y) >= threshold_or_default(threshold))), F.lit(False))


def cache_key(request_type: Column | str, prompt: Column | str) -> Column:
    return F.concat_ws(":", F.lower(col(request_type)), F.coalesce(F.md5(col(prompt)), F.lit("null")))


def file_name(path: Column | str) -> Column:
    """The last part of a path; null for null."""
    return F.element_at(F.split(col(path), "/"), -1)


def safe_name(name: Column | str) -> Column:
    """A file name without characters that file systems refuse, of 80 characters at most; 'document' for a blank one."""
    n = F.substring(F.regexp_replace(col(name), FORBIDDEN_IN_NAMES, "_"), 1, 80)
    return F.when(is_blank(n), "document").otherwise(n)


def valid_base_name(name: Column | str) -> Column:
    n = col(name)
    return F.coalesce(n.rlike(NAME_PATTERN) & (F.length(n) <= NAME_LENGTH), F.lit(False))


def summary_budget(c: Column | str) -> Column:
    """A long summary reduced to its beginning and end."""
    t = col(c)
    return F.when(F.length(t) > SUMMARY_BUDGET, F.concat(F.substring(t, 1, SUMMARY_HALF), F.lit(" ... "), F.right(t, F.lit(SUMMARY_HALF)))).otherwise(t)


def leaf_name(summary: Column | str, chapter: Column | str, title: Column | str, doc_id: Column | str) -> Column:
    """The first 50 characters of the summary, else of the chapter's title, else of the document's title, else the id."""
    parts = [F.when(~is_blank(c), truncated(c, 50)) for c in (summary, chapter, title)]
    return F.coalesce(*parts, col(doc_id))


def numbered(items: Column | str, template: str = "[{i}] {x}", separator: str = "\n\n") -> Column:
    """Array entries as numbered blocks, counted from 1."""
    before, _, rest = template.partition("{i}")
    middle, _, after = rest.partition("{x}")
    return F.array_join(F.transform(col(items), lambda x, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(middle), F.trim(x), F.lit(after))), separator)


def described(names: Column | str, descriptions: Column | str) -> Column:
    """'[i] name - description' lines of parallel arrays, counted from 0."""
    both = F.arrays_zip(col(names).alias("n"), col(descriptions).alias("d"))
    return F.array_join(F.transform(both, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["n"], F.lit(" - "), F.coalesce(x["d"], F.lit("")))), "\n")
