"""Identifiers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEWS = ("front", "back", "left", "right")


def parse_id(c: Column) -> dict[str, Column]:
    """Site, cohort and number of a subject's identifier: first two characters, ST or CTC inside, last run of digits."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return {
        "site": F.substring(c, 1, 2),
        "cohort": F.when(c.contains("ST"), "ST").when(c.contains("CTC"), "CN").otherwise("unknown"),
        "number": F.when(F.size(runs) > 0, F.element_at(runs, -1)).otherwise(""),
    }


def view_of(name: Column, views: tuple[str, ...] = VIEWS) -> Column:
    """The first of the views that the lower-cased name holds; else null."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(v), F.lit(v)) for v in views))


def subject_of(name: Column) -> Column:
    """What comes before the first underscore; null without one."""
    return F.when(name.contains("_"), F.substring_index(name, "_", 1))


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(extensions) + ")$")


def normal_path(path: Column) -> Column:
    """A path without scheme, doubled separators and dots, of any depth; parents above the root stay at the root, those that begin a relative path stay."""
    plain = F.regexp_replace(path, r"^file:/*", "/")
    rooted = plain.startswith("/")

    def step(kept: Column, s: Column) -> Column:
        """The segments kept so far after one more; the first is a mark of the bottom."""
        last, more = F.element_at(kept, -1), F.concat(kept, F.array(s))
        parent = F.when(last == "/", F.when(rooted, kept).otherwise(more)).when(last == "..", more).otherwise(F.slice(kept, 1, F.size(kept) - 1))
        return F.when(s.isin("", "."), kept).when(s == "..", parent).otherwise(more)

    stack = F.aggregate(F.split(plain, "/"), F.array(F.lit("/")), step)
    joined = F.array_join(F.slice(stack, 2, F.size(stack)), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def pseudo_id(prefix: Column, identifier: Column, salt: str, digits: int = 8) -> Column:
    """Prefix and a salted hash; the salt is the caller's secret."""
    return F.concat(prefix, F.lit("_"), F.substring(F.sha2(F.concat(F.lit(salt), identifier), 256), 1, digits))
