"""Vocabulary functions: document types, roles, open access, dates, abstracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openness of a status.
OA_RANK = {"diamond": 8, "gold": 7, "hybrid": 6, "bronze": 5, "green": 4, "embargoed": 3, "closed": 2, "unknown": 1}
# Article subtypes that beat plain ``article``.
ARTICLE_SUBTYPES = ("review", "book_review", "data_paper", "conference_paper", "editorial", "letter", "erratum", "retraction")
# Families of document types.
FAMILIES = {"thesis": "theses", "ongoing_thesis": "theses", "memoir": "theses", "preprint": "preprints", "dataset": "data", "software": "data"}


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A dictionary as a map literal; unknown and null values give ``default``."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    out = F.try_element_at(m, c)
    return out if default is None else F.coalesce(out, default)


def oa_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OA_RANK.items() for x in kv]), c), F.lit(0))


def best_oa(c: Column) -> Column:
    """F19 as an aggregate: the most open known status."""
    return F.max_by(c, F.when(oa_rank(c) > 0, oa_rank(c)))


def decide_oa(current: Column, found: Column, deposit: Column | None = None) -> Column:
    """the status after a check; it keeps a diamond beside gold, an embargo and an open deposit beside closed ones."""
    shut = found.isin("closed", "unknown")
    held = F.coalesce(deposit, F.lit(False)) if deposit is not None else F.lit(False)
    keep = (current == found) | ((current == "diamond") & (found == "gold")) | ((current == "embargoed") & shut) | (held & shut)
    return F.when(found.isNull() | F.coalesce(keep, F.lit(False)), current).otherwise(found)


def expected_oa(model: Column, status: Column) -> Column:
    """whether a status is what the journal's model lets expect; an unknown model expects nothing."""
    return F.when(model == "full_oa", status.isin("gold", "diamond")).when(model == "subscription", ~status.isin("gold", "diamond"))


def iso_date(c: Column) -> Column:
    """dd/MM/yyyy to a date, null if there is no such day."""
    return F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date")


def first_year(*paths: Column) -> Column:
    """the first value, by preference, that holds a year."""
    return F.coalesce(*[F.nullif(F.regexp_extract(p.cast("string"), r"\b((?:1[5-9]|20)\d{2})\b", 1), F.lit("")).cast("int") for p in paths])


def abstract_from_index(index: Column) -> Column:
    """the text of an inverted index (JSON map of word to positions), without a shuffle."""
    m = F.from_json(index, "map<string,array<int>>")
    words = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "), F.lit(""))


# Words that mark a part of a book in a normalised title.
CHAPTER_WORDS = r"\b(chapitre|chapter|chap|ch|section|sec|partie|part|vol|tome|pp|p)\b"


def chapter_title(c: Column) -> Column:
    """a normalised title without numbers and the words that mark a part."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\d+", " "), CHAPTER_WORDS, " "), r"\s+", " "))


def distinct_chapters(titles: Column) -> Column:
    """whether two of the normalised titles are really different: neither contains the other once cleaned. Empty ones don't count."""
    cleaned = F.array_distinct(F.filter(F.transform(titles, chapter_title), lambda t: t != ""))
    return F.exists(cleaned, lambda a: F.exists(cleaned, lambda b: ~F.contains(a, b) & ~F.contains(b, a)))
