"""Person names as Column expressions: parsing, forms, compatibility, edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions.text import normalize_text


def parse_name(c: Column) -> Column:
    """struct(last, first) of "Last, First" or "First ... Last"; a single word is a last name."""
    s = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    comma = F.contains(s, F.lit(","))
    parts = F.split(s, " ")
    last = F.when(comma, F.trim(F.split_part(s, F.lit(","), F.lit(1)))).otherwise(F.element_at(parts, -1))
    first = F.when(comma, F.trim(F.regexp_replace(s, r"^[^,]*,\s*", ""))).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.struct(last.alias("last"), first.alias("first"))


def initials(first: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.filter(F.split(first, "[ -]+"), lambda t: t != ""), lambda t: F.substring(t, 1, 1)), sep)


def name_forms(last: Column, first: Column) -> Column:
    """distinct forms: both orders with the full first name, with spaced and with joined initials."""
    spaced, joined = initials(first, " "), initials(first, "")
    both = lambda f: [F.concat_ws(" ", last, f), F.concat_ws(" ", f, last)]
    return F.array_distinct(F.filter(F.transform(F.array(*both(first), *both(spaced), *both(joined)), lambda x: F.trim(x)), lambda x: x != ""))


def within_one_edit(a: Column, b: Column) -> Column:
    """F16: at most one insertion, deletion, substitution or swap of neighbours.

    Levenshtein covers the first three; a swap leaves equal lengths and two edits, and the letters in
    between, cut by the common head and tail, are each other's reverse.
    """
    close = F.coalesce(F.levenshtein(a, b, 2), F.lit(-1))
    n = F.length(a)
    head = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    x, y = F.substring(a, head + 1, F.lit(2)), F.substring(b, head + 1, F.lit(2))
    swap = (n == F.length(b)) & (F.length(x) == 2) & (x == F.reverse(y)) & (F.substring(a, head + 3, n) == F.substring(b, head + 3, n))
    return F.when(close.between(0, 1), True).when(close == 2, swap).otherwise(False)


def one_short(c: Column) -> Column:
    """A text and its forms with one letter less; two texts within one edit of each other share one."""
    n = F.length(c)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.array_append(less, c))


def name_tokens(*parts: Column) -> Column:
    """the set of words of a name without accents, signs and digits (years of birth stand beside some names)."""
    text = F.regexp_replace(normalize_text(F.concat_ws(" ", *parts)), r"\d+", " ")
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def compatible(a: Column, b: Column) -> Column:
    """every token of the smaller set fits one of the larger: equal, or an initial of it; an empty set fits nothing."""
    fits = lambda t, u: (t == u) | ((F.length(t) == 1) & F.startswith(u, t)) | ((F.length(u) == 1) & F.startswith(t, u))
    small, big = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return (F.size(a) > 0) & (F.size(b) > 0) & F.forall(small, lambda t: F.exists(big, lambda u: fits(t, u)))


def names_compatible(a: Column, b: Column) -> Column:
    """F15 on two whole names, in any order of their parts."""
    return compatible(name_tokens(a), name_tokens(b))


def close_part(a: Column, b: Column) -> Column:
    """F16: family names, or given names, apart by spelling only: same words, same letters, or one edit if both have two letters or more."""
    ta, tb = name_tokens(a), name_tokens(b)
    joined = lambda c: F.replace(F.regexp_replace(normalize_text(c), r"\d+", ""), F.lit(" "), F.lit(""))
    x, y = joined(a), joined(b)
    same = (F.array_sort(ta) == F.array_sort(tb)) | (x == y) | ((F.length(x) >= 2) & (F.length(y) >= 2) & within_one_edit(x, y))
    return (F.size(ta) > 0) & (F.size(tb) > 0) & same


def same_person(last_a: Column, first_a: Column, last_b: Column, first_b: Column) -> Column:
    """F16: names of one person: compatible as sets of words, or family and given name each apart by spelling only."""
    whole = compatible(name_tokens(last_a, first_a), name_tokens(last_b, first_b))
    return F.coalesce(whole, F.lit(False)) | F.coalesce(close_part(last_a, last_b) & close_part(first_a, first_b), F.lit(False))
