"""Identifier normalisation as Column expressions; null in, null out, null if invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# Patterns of the identifiers below.
DASHES = "‐‑‒–—―−﹘﹣－"
DOI_HEAD = r"^(?:doi\s*[:=]\s*|(?:https?://)?[a-z.]*doi\.[a-z.]+/)+"
DOI_TAIL = r"(?:/pdf|/full|\.v\d+|[/.,:<>\]}\"'])+$"


def clean_doi(c: Column) -> Column:
    """F8: scheme and host, percent codes, odd dashes, query, further DOIs, trailing marks, ``/pdf`` and ``.vN`` away, to the end.

    Each pattern takes a whole run, so nothing is left for another round; only an unmatched bracket at
    the end can uncover a further run, and those few values are shortened sign by sign.
    """
    s = F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", "")))
    s = F.regexp_replace(s, f"[{DASHES}]", "-")
    s = F.replace(F.regexp_replace(s, r"%(?:25)+", "%"), F.lit("+"), F.lit("%2b"))
    s = F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(s), s)), r"\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, DOI_HEAD, ""), r"[?#;].*$", "")
    s = F.regexp_replace(s, DOI_TAIL, "")

    def shorter(x: Column) -> Column:
        """``x`` without an unmatched bracket at its end and the run before it."""
        count = lambda ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
        lone = (F.endswith(x, F.lit(")")) & (count(")") > count("("))) | (F.endswith(x, F.lit("(")) & (count("(") > count(")")))
        return F.when(lone, F.regexp_replace(F.substring(x, F.lit(1), F.length(x) - 1), DOI_TAIL, "")).otherwise(x)

    ended = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), s, lambda acc, _: shorter(acc))
    s = F.when(s.rlike(r"[()]$"), ended).otherwise(s)
    return F.when(s.rlike(r"^10\.\d{4,9}/\S+$"), s)


def hal_id(c: Column) -> Column:
    return _or_null(F.regexp_extract(F.lower(c), r"([a-z][a-z0-9]*-\d{8,})", 1))


def nnt(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.rlike(r"^[0-9A-Z]+$"), s)


def pmid(c: Column) -> Column:
    return _or_null(F.regexp_extract(F.trim(c), r"(?i)^(?:https?://\S*?/|pmid:?\s*)?([1-9]\d*)/?$", 1))


def pmcid(c: Column) -> Column:
    d = F.regexp_extract(F.trim(c), r"(?i)^(?:https?://\S*?/)?(?:pmc)?(\d+)/?$", 1)
    return F.when(d != "", F.concat(F.lit("PMC"), d))


def arxiv_id(c: Column) -> Column:
    return _or_null(F.regexp_extract(F.lower(F.trim(c)), r"(?:arxiv:|/abs/|^)(\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?$", 1))


def orcid(c: Column) -> Column:
    s = F.upper(F.regexp_extract(F.trim(c), r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dx])$", 1))
    return _or_null(s)


def idref(c: Column) -> Column:
    return _or_null(F.upper(F.regexp_extract(F.trim(c), r"(?i)(?:^|/)(\d{8}[\dx])$", 1)))


def hal_person_id(c: Column) -> Column:
    return _or_null(F.regexp_extract(F.trim(c), r"^([1-9][0-9]*)$", 1))


def ror_id(c: Column) -> Column:
    return _or_null(F.regexp_extract(F.lower(F.trim(c)), r"(?:^|/)(0[a-z0-9]{6}\d{2})$", 1))


def hal_collection(c: Column) -> Column:
    s = F.upper(F.trim(c))
    return F.when(s.rlike(r"^[A-Z0-9][A-Z0-9_-]*$"), s)


def ids_from_urls(urls: Column) -> Column:
    """distinct (type, value) structs of DOIs, deposits, PubMed, PubMed Central and arXiv ids found in an array of URLs."""
    kinds = {
        "doi": lambda u: F.when(u.rlike(r"(?i)^doi:|doi\.[a-z.]+/"), clean_doi(u)),
        "hal_id": hal_id,
        "pmid": lambda u: F.when(u.rlike(r"(?i)pubmed"), pmid(u)),
        "pmcid": lambda u: F.when(u.rlike(r"(?i)pmc"), pmcid(u)),
        "arxiv_id": lambda u: F.when(u.rlike(r"(?i)arxiv"), arxiv_id(u)),
    }
    one = lambda u: F.filter(F.array(*[F.struct(F.lit(k).alias("type"), f(u).alias("value")) for k, f in kinds.items()]), lambda x: x["value"].isNotNull())
    return F.array_distinct(F.flatten(F.transform(F.filter(urls, lambda u: u.isNotNull()), one)))


#: The check of each kind of identifier; a value is sound if its normal form is not null.
CHECKS = {
    "doi": clean_doi, "hal_id": hal_id, "nnt": nnt, "pmid": pmid, "pmcid": pmcid, "arxiv_id": arxiv_id,
    "orcid": orcid, "idref": idref, "hal_person_id": hal_person_id, "ror": ror_id, "hal_collection": hal_collection,
}


def validate(kind: str, c: Column) -> Column:
    """struct(value, error): the normal form of a value, or why there is none (``empty``, ``malformed``); unknown kinds raise ValueError."""
    if kind not in CHECKS:
        raise ValueError(f"unknown identifier {kind!r}")
    value = CHECKS[kind](c)
    error = F.when(c.isNull() | (F.trim(c) == ""), "empty").when(value.isNull(), "malformed")
    return F.struct(value.alias("value"), error.alias("error"))
