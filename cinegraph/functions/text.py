"""String functions whose semantics differ between SQL engines, pinned down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_pattern(pattern: str) -> str:
    """A LIKE pattern as Spark takes it: a backslash before anything but %, _ or itself only escapes that character.

    Raises ValueError for a pattern that ends in a lone backslash, as SQL engines do.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            if i + 1 == len(pattern):
                raise ValueError("LIKE pattern must not end with an escape character")
            out.append(pattern[i : i + 2] if pattern[i + 1] in "%_\\" else pattern[i + 1])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def literals(pattern: str) -> list[str]:
    """The runs of plain characters of a pattern as like_pattern() gives it, between its wildcards."""
    out, i = [""], 0
    while i < len(pattern):
        if pattern[i] in "%_":
            out.append("")
        else:
            i += pattern[i] == "\\"
            out[-1] += pattern[i]
        i += 1
    return [x for x in out if x]


def trigrams(column: str) -> str:
    """The expression of the distinct runs of three characters of a column in small letters; none of a null or shorter text."""
    low = f"lower({column})"
    return f"array_distinct(if(length({low}) >= 3, transform(sequence(1, length({low}) - 2), i -> substring({low}, i, 3)), array()))"


def genre_prefix(genre: str) -> str:
    """The pattern of a genre search: white space goes, and anything may follow."""
    return like_pattern("".join(genre.split()) + "%")


def items(csv: Column, compat: bool = False) -> Column:
    """The items of a comma list; in compat mode trailing empty items go, as they do on the JVM."""
    return F.split(F.regexp_replace(csv, ",+$", "") if compat else csv, ",")


def comma_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))


def no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, '"', "'")


def first_ids(c: Column, last_id_length: int, most: int = 5) -> Column:
    """A list of ids cut to what most ids of the given length take, by characters; ids of other lengths can be cut."""
    return F.substring(c, 1, (last_id_length + 1) * most - 1)


def first_whole_ids(c: Column, most: int = 5) -> Column:
    return F.array_join(F.slice(F.split(c, ","), 1, most), ",")


def path_segment(c: Column) -> Column:
    """A segment of a URL path, decoded."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
