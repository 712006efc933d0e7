"""Ordered rule classifier and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

# Document types, and those that are retained.
TYPES = ("story_transcript", "character", "sinner", "abnormality", "faction", "location", "world", "event", "identity", "ego", "other")
RETAINED = TYPES[:8]
# Titles that rules name.
OVERVIEW_TITLES = ("identity", "e.g.o.", "e.g.o", "ego")
SINNER_TITLES = ("yi sang", "faust", "don quixote", "ryoshu", "meursault", "hong lu", "heathcliff", "ishmael", "rodion", "sinclair", "outis", "gregor")


# Rules in order, (type, field, test, values). A rule holds if a value passes its test on the
# title or on a category; "media" is a title test of its own. "unless" takes a category that forbids the rule.
RULES = (
    ("world", "title", "is", OVERVIEW_TITLES),
    ("other", "title", "media", ()),
    ("identity", "category", "has", ("identit",)),
    ("identity", "title", "ends", ("/identity", "/identity story")),
    ("ego", "title", "has", ("e.g.o",), "abnormality"),
    ("ego", "category", "has", ("e.g.o",), "abnormality"),
    ("ego", "category", "is", ("ego",), "abnormality"),
    ("sinner", "category", "has", ("sinner",)),
    ("sinner", "title", "is", SINNER_TITLES),
    ("abnormality", "category", "has", ("abnormality",)),
    ("faction", "category", "has", ("faction", "syndicate", "wing")),
    ("location", "category", "has", ("location", "district")),
    ("character", "category", "has", ("character",)),
    ("story_transcript", "category", "is", ("story", "cantos")),
    ("story_transcript", "category", "starts", ("canto ",)),
    ("story_transcript", "title", "starts", ("canto ",)),
    ("story_transcript", "title", "has", ("intervallo",)),
    ("event", "category", "has", ("event",)),
    ("world", "category", "has", ("world", "lore", "the city")),
    ("faction", "title", "has", ("league of nine",)),
    ("world", "title", "is", ("the mirror",)),
)


def document_type(title: Column, categories: Column) -> Column:
    """Type by the first of RULES that holds."""
    t = F.lower(T.strip(title))
    cats = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    tests = {"is": lambda x, v: x == v, "has": lambda x, v: x.contains(v), "starts": lambda x, v: x.startswith(v), "ends": lambda x, v: x.endswith(v)}

    def holds(field, test, values, unless=None):
        if test == "media":
            return T.is_media_page(title)
        some = lambda x: reduce(Column.__or__, [tests[test](x, v) for v in values])
        met = some(t) if field == "title" else F.exists(cats, some)
        return met & ~F.array_contains(cats, unless) if unless else met

    return reduce(lambda rest, rule: F.when(holds(*rule[1:]), rule[0]).otherwise(rest), reversed(RULES), F.lit("other"))


def is_retained(kind: Column) -> Column:
    return kind.isin(*RETAINED)


def matches(title: Column, kind: Column, chapters: Column, types: list[str] | None = None, labels: list[str] | None = None, max_chapter: str | int | None = None) -> Column:
    """Retrieval filter: media pages never pass; types and labels if given; rows of which
    any known chapter number is over the cap don't pass, rows without one do."""
    keep = ~T.is_media_page(title)
    if types:
        keep &= kind.isin(*types)
    if labels:
        keep &= F.arrays_overlap(chapters, F.array(*map(F.lit, labels)))
    if max_chapter is not None:
        cap = T.chapter_number(F.lit(str(max_chapter)))
        keep &= ~F.exists(chapters, lambda c: F.coalesce(T.chapter_number(c) > cap, F.lit(False)))
    return F.coalesce(keep, F.lit(False))
