"""Text normalisation as Column expressions (JVM side, no Python UDF)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters without a decomposition, and what they are written as.
STANDALONE_LETTERS = {
    "œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "đ": "d", "ð": "d", "þ": "th",
    "ł": "l", "ħ": "h", "ı": "i", "ŋ": "n", "ĸ": "k", "ŧ": "t",
}


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): single characters with their base letter by NFKD, and the multi-letter ones.

    Built from the Unicode database for Latin, letter-like, sub- and superscript blocks.
    """
    src, dst, longer = [], [], []
    blocks = [(0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2150), (0xFF01, 0xFF5F)]
    for lo, hi in blocks:
        for cp in range(lo, hi):
            ch = chr(cp).lower()
            if len(ch) != 1 or ch in STANDALONE_LETTERS:
                continue
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
            if base != ch and len(base) == 1 and ch not in src:
                src.append(ch)
                dst.append(base)
    for ch, base in STANDALONE_LETTERS.items():
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
        else:
            longer.append((ch, base))
    longer += [(c, unicodedata.normalize("NFKD", c)) for c in "½¼¾ﬁﬂﬀ…"]
    return "".join(src), "".join(dst), tuple(longer)


def strip_markup(c: Column) -> Column:
    """Tags (a name right after ``<``) become a blank; other angle brackets, e.g. ``<111>``, stay."""
    return F.regexp_replace(c, r"</?[A-Za-z][^>]*>", " ")


def unaccent(c: Column) -> Column:
    """Lower case without accents: translate table plus a handful of multi-letter replacements."""
    src, dst, longer = fold_table()
    out = F.translate(F.lower(c), src, dst)
    for a, b in longer:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\p{M}+", "")


def normalize_text(c: Column) -> Column:
    """Markup to blanks, lower case, accents folded, runs of all but a-z0-9 to one blank, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(unaccent(strip_markup(c)), r"[^a-z0-9]+", " "))


def normalize_label(c: Column) -> Column:
    """White space to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def sanitize_raw_text(c: Column) -> Column:
    """Unicode blanks to a blank, control, format, surrogate and private characters away."""
    out = F.regexp_replace(c, r"[\p{Z}\t\n\r\f]+", " ")
    return F.trim(F.regexp_replace(out, r"[\p{Cf}\p{Cc}\p{Cs}\p{Co}]+", ""))


@lru_cache(maxsize=1)
def entity_table() -> dict[str, str]:
    """Every named character reference of HTML (with its semicolon) and its text."""
    return {f"&{name}": text for name, text in html5.items() if name.endswith(";")}


def decode_entities(c: Column) -> Column:
    """Named and numeric character references as their characters, to the end also where they were encoded repeatedly.

    Repeated encoding only repeats the ampersand (``&amp;amp;lt;``), so that is undone first, at any depth;
    then each reference that stands in the text is replaced. Unknown references stay.
    """
    amp = r"&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+"
    flat = F.regexp_replace(c, amp + r"(?=(?:[A-Za-z][A-Za-z0-9]*|#\d+|#[xX][0-9A-Fa-f]+);)", "&")
    found = F.array_distinct(F.regexp_extract_all(flat, F.lit(r"(&(?:[A-Za-z][A-Za-z0-9]*|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});)"), 1))
    named = F.map_from_arrays(F.array(*map(F.lit, entity_table())), F.array(*map(F.lit, entity_table().values())))

    def text_of(e: Column) -> Column:
        digits = F.regexp_extract(e, r"^&#(\d+);$", 1)
        code = F.when(digits != "", F.hex(digits.cast("bigint"))).otherwise(F.regexp_extract(e, r"^&#[xX]([0-9A-Fa-f]+);$", 1))
        value = F.conv(code, 16, 10).cast("bigint")
        sound = (code != "") & value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        numeric = F.when(sound, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        return F.coalesce(numeric, F.try_element_at(named, e), e)

    # The ampersand comes last, so that what it leaves isn't read as a reference again.
    order = F.concat(F.filter(found, lambda e: ~e.isin("&amp;", "&AMP;", "&#38;", "&#x26;")), F.filter(found, lambda e: e.isin("&amp;", "&AMP;", "&#38;", "&#x26;")))
    out = F.aggregate(F.transform(order, lambda e: F.struct(e.alias("e"), text_of(e).alias("t"))), flat, lambda acc, x: F.replace(acc, x["e"], x["t"]))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def clean_title(c: Column) -> Column:
    """Entities decoded, white space collapsed, trimmed; an empty title is null."""
    out = F.trim(F.regexp_replace(decode_entities(c), r"(?U)\s+", " "))
    return F.when(out != "", out)
