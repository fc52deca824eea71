"""Problem 3: mapping values typed freely to the closest entry of a reference list.

A prefix-filter set-similarity join finds the candidates: both sides become sets of word-start
trigrams ordered by global rarity, only the rare prefixes are joined, length and positional filters
prune, and Jaccard is verified exactly. Of the candidates whose words can be read as the entry's words
(equal, abbreviated or mistyped, same series) the one with the highest Jaccard is kept.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.text import STANDALONE_LETTERS
from corvina.operators.graph import lookup
from corvina.session import Cut, spread, table

#: Least Jaccard similarity of the trigram sets of a candidate.
THRESHOLD = 0.22
#: Rows of one token that one task joins; a token with more is split.
BLOCK = 10_000
# What stands for "none given" once folded.
NOTHING = ("", "n a", "na", "n d", "nd", "none", "null", "nan", "unknown", "inconnu", "non renseigne", "not available", "not given", "not specified", "undefined", "unspecified", "sans", "sans objet", "aucun", "s n", "s l", "tba", "tbd", "0")
# Words that additions bring and that name nothing.
ADDITIONS = ("the", "online", "print", "ltd", "sas", "sa", "inc", "gmbh", "llc", "co", "en ligne", "imprime", "sarl", "cie", "plc", "bv", "ag", "electronic", "group", "groupe", "publisher")
# Joining words that may be left out.
JOINING = ("de", "of", "du", "des", "la", "le", "les", "d", "and", "et", "in", "for", "l", "fur", "der", "und", "y", "en")


#: A UTF-8 lead byte (as it looks in a Western single-byte text, also after a change of case) and what follows it.
GARBLED = re.compile("[A\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")


def _bytes(run: str) -> bytes:
    out = bytearray()
    for ch in run:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            out.append(ord(ch) & 0xFF)
    return bytes(out)


def _repair_run(m: re.Match) -> str:
    raw = _bytes(m.group())
    leads = (0xC3,) if raw[0] == 0x41 else (raw[0], raw[0] - 0x20 if raw[0] >= 0xE0 else raw[0])
    for lead in leads:  # the case or the accent of the lead byte may have gone after the damage
        try:
            return (bytes([lead]) + raw[1:]).decode("utf-8")
        except UnicodeDecodeError:
            continue
    return m.group()


def mended_text(t: str) -> str:
    """``t`` with UTF-8 that was read as a Western single-byte text put right where it decodes, also where that happened repeatedly."""
    while not t.isascii() and (u := GARBLED.sub(_repair_run, t)) != t:
        t = u
    return t


_KEY = {
    name: re.compile(x)
    for name, x in {
        "bracket": r"\((?!\s*ser)[^()]*\)",  # a place or an edition
        "tail": r"(?:[.;:,/-]\s*(?:rev(?:ue|iew)?|journal|j)?\.? ?(?:en ligne|online|on line)\W*)+$",
        "odd": r"[^a-z0-9.]+", "dotted": r"\.(?=[a-z0-9])", "dots": r"(?<![a-z0-9])\.+|\.(?=\.)", "added": rf"\b(?:{'|'.join(ADDITIONS)})\b\.?",
    }.items()
}
_LETTERS = str.maketrans(STANDALONE_LETTERS)


def key_of(text: str) -> str:
    """Folded words of a name; dots after a word stay as a mark of abbreviation."""
    while (t := html.unescape(text)) != text:
        text = t
    t = unicodedata.normalize("NFKD", mended_text(text).lower().translate(_LETTERS))
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = _KEY["tail"].sub(" ", _KEY["bracket"].sub(" ", t))
    t = _KEY["dots"].sub("", _KEY["dotted"].sub(". ", _KEY["odd"].sub(" ", t)))
    return " ".join(_KEY["added"].sub(" ", t).split())


def keyed(values: DataFrame) -> DataFrame:
    """(value, k) of the distinct values that aren't null; Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": pdf["value"], "k": [key_of(v) for v in pdf["value"]]})

    return spread(values.where("value is not null").select("value").distinct()).mapInPandas(run, "value string, k string")


def plain(c: Column) -> Column:
    """A key without the dots."""
    return F.trim(F.regexp_replace(c, r"[. ]+", " "))


def grams(k: Column) -> Column:
    """Distinct trigrams of each word that isn't a joining word, its start marked."""
    words = F.filter(F.split(plain(k), " "), lambda w: (F.length(w) > 0) & ~w.isin(*JOINING))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(F.concat(F.lit("^"), w), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def prefix_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(lid, rid, jaccard) of all pairs of sets with Jaccard >= ``threshold``.

    Sides: (lid | rid, toks array). Tokens are ranked by their count on both sides, rarest first; two
    sets reach the threshold only if their prefixes of |x| - ceil(t |x|) + 1 tokens meet. The join is an
    equi-join on prefix tokens, split where a token is hot, with length and positional filters; only ids
    go through it, the sets are fetched for the distinct candidates, and Jaccard is exact. Empty sets pair
    with nothing. Every candidate is verified, none is dropped.
    """
    cut = Cut(left.sparkSession)
    counts = cut(
        left.select(F.explode(F.array_distinct("toks")).alias("t")).unionByName(right.select(F.explode(F.array_distinct("toks")).alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    )

    def ordered(df: DataFrame, rid: str) -> DataFrame:
        """Tokens in rarity order, as hashes, each with its count."""
        x = df.select(rid, F.explode(F.array_distinct("toks")).alias("t")).join(counts, "t")
        return cut(x.groupBy(rid).agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("t").alias("t")))).alias("o")))

    def prefixes(df: DataFrame, rid: str, p: str) -> DataFrame:
        size = F.size("o")
        keep = size - F.ceil(F.lit(threshold) * size - 1e-9) + 1
        x = df.select(rid, size.alias(f"{p}n"), F.posexplode(F.slice("o", F.lit(1), keep.cast("int"))).alias(f"{p}p", "e"))
        return x.select(rid, f"{p}n", f"{p}p", F.col("e.t").alias("t"), F.ceil(F.col("e.n") / BLOCK).cast("int").alias("parts"))

    lo, ro = ordered(left, "lid"), ordered(right, "rid")
    a = prefixes(lo, "lid", "l").withColumn("s", F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int")).drop("parts")
    b = prefixes(ro, "rid", "r").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    la, lb = F.col("ln"), F.col("rn")
    need = F.lit(threshold / (1 + threshold)) * (la + lb)
    pairs = (
        a.join(b, ["t", "s"])
        .where((la >= F.lit(threshold) * lb - 1e-9) & (lb >= F.lit(threshold) * la - 1e-9))
        .where(F.least(la - F.col("lp"), lb - F.col("rp")) >= need - 1e-9)
        .select("lid", "rid")
        .distinct()
    )
    words = lambda df, rid, name: df.select(rid, F.transform("o", lambda x: x["t"]).alias(name))
    both = F.size(F.array_intersect("lo", "ro"))
    j = both / (F.size("lo") + F.size("ro") - both)
    out = pairs.join(words(lo, "lid", "lo"), "lid").join(words(ro, "rid", "ro"), "rid")
    return cut.keep(out.select("lid", "rid", j.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12))


def _osa(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return one[-1]


def _series(words: list[str]) -> tuple[str, list[str]]:
    """The series mark, and the other words."""
    for k in range(len(words) - 1):
        if words[k].rstrip(".") in ("series", "serie", "ser", "section", "sect", "part") and len(words[k + 1].rstrip(".")) <= 2:
            return words[k + 1].rstrip("."), words[:k] + words[k + 2 :]
    return "", words


def aligned(mention: str, entry: str) -> float | None:
    """Cost (0 best) of reading ``mention`` as ``entry``, None if it can't be: both as ``key`` gives them.

    Every word of the mention must be a word of the entry, whole, mistyped (one edit up to six
    letters, else two) or abbreviated; words of the entry left over must be joining words. The series
    must be the same. Word order does not matter.
    """
    sm, wm = _series(mention.split())
    se, we = _series(entry.split())
    if sm != se:
        return None
    join = set(JOINING)
    wm = [w for w in wm if w.rstrip(".") not in join]
    rest = [w.rstrip(".") for w in we if w.rstrip(".") not in join]
    if not wm or len(wm) != len(rest):
        if abs(len(wm) - len(rest)) != 1 or "".join(sorted("".join(w.rstrip(".") for w in wm))) != "".join(sorted("".join(rest))):
            return None  # a blank more or less is allowed only if no letter differs
        return 1.0
    cost, edits = 0.0, 0
    for w in sorted(wm, key=lambda w: -len(w)):
        dotted, w = w.endswith("."), w.rstrip(".")
        best = None
        for k, e in enumerate(rest):
            if w == e:
                c = 0.0
            elif e.startswith(w) and len(w) < len(e) and (dotted or len(w) >= 2):
                c = 0.2 if dotted else 0.4
            elif min(len(w), len(e)) >= 3 and _osa(w, e, 2 if len(e) >= 7 else 1) <= (2 if len(e) >= 7 else 1):
                c = 0.5 + 0.1 * _osa(w, e, 2)
            elif dotted and len(w) >= 4 and _osa(w, e[: len(w)], 1) <= 1:
                c = 0.8
            elif dotted and len(w) >= 2 and w[0] == e[0] and len(w) <= 4 and _is_contraction(w, e):
                c = 0.9
            else:
                continue
            if best is None or c < best[0]:
                best = (c, k)
        if best is None:
            return None
        cost += best[0]
        edits += best[0] >= 0.5
        rest.pop(best[1])
    return cost if edits <= 3 else None


def _is_contraction(w: str, e: str) -> bool:
    it = iter(e)
    return all(ch in it for ch in w)


def map_values(spark: SparkSession, mentions: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value, canonical_id, jaccard) of each distinct ``value`` of ``mentions`` that names something.

    ``entries``: (canonical_id, name). canonical_id is 0 where no entry can be meant. Of the candidates
    that the value can be read as, the one with the highest Jaccard is kept; ties go to the lower reading
    cost, then to the smaller id. Null, blank and "none given" values have no row.
    """
    cut = Cut(spark)
    vals = cut(keyed(mentions).where(~plain(F.col("k")).isin(*NOTHING)))
    keys = vals.select(F.col("k").alias("lid")).distinct()
    known = entries.where("name is not null").select(F.col("canonical_id").alias("rid"), F.col("name").alias("value"))
    refs = cut(known.join(keyed(known), "value").select("rid", F.col("k").alias("rk")))
    pairs = prefix_join(
        keys.select("lid", grams(F.col("lid")).alias("toks")), refs.select("rid", grams(F.col("rk")).alias("toks")), threshold
    ).join(refs, "rid")

    @F.pandas_udf("double")
    def cost(m: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([aligned(a, b) for a, b in zip(m, e)], dtype="float64")

    best = (
        spread(pairs).withColumn("cost", cost("lid", "rk"))
        .where("cost is not null and not isnan(cost)")
        .groupBy("lid")
        .agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "cost", "rid")).alias("b"))
        .select(F.col("lid").alias("k"), F.col("b.rid").alias("canonical_id"), (-F.col("b.j")).alias("jaccard"))
    )
    out = vals.join(best, "k", "left").select("value", F.coalesce("canonical_id", F.lit(0).cast("bigint")).alias("canonical_id"), "jaccard")
    return cut.keep(out)


def _mapped(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "venue_mentions")
    out = None
    for field, column, name in (("publisher", "publisher_name", "publishers"), ("journal", "journal_title", "journals")):
        entries = table(spark, base, name).select(F.col("id").alias("canonical_id"), F.col("name" if name == "publishers" else "title").alias("name"))
        values = m.select(F.col("id").alias("mention_id"), F.lit(field).alias("field"), F.col(column).alias("value"))
        mapped = map_values(spark, values, entries)
        part = lookup(values, mapped, "value").where("canonical_id is not null").select("mention_id", "field", "value", "canonical_id", "jaccard")
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return _mapped(spark, base).select("mention_id", "field", "canonical_id").distinct()


def p3_unmatched(spark: SparkSession, base: str) -> DataFrame:
    """The report of values that the lists lack: (field, value, mentions)."""
    return _mapped(spark, base).where("canonical_id = 0").groupBy("field", "value").agg(F.countDistinct("mention_id").alias("mentions"))
