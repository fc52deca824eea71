"""Problem 7: the same postal address written differently.

An address is reduced to what places it: number, kind of street, street name, town, postal code. Street
names within one town or postal code, and town names of one street, become character n-grams weighted
by rarity; candidates come from an inverted index over the weight prefixes that a cosine threshold
leaves, and are verified by exact cosine, edits and postal code. Linked spellings form streets; a place
is a number in a street.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm.canonical import _osa
from corvina.operators.graph import class_pairs, connected_components, lookup
from corvina.session import Cut, spread, table

#: Least cosine of the weighted n-grams of two spellings of a street, and of a town.
STREET_COSINE, TOWN_COSINE = 0.2, 0.3
# Kinds of street and their abbreviations.
KINDS = {
    "rue": "rue", "r": "rue", "avenue": "avenue", "ave": "avenue", "av": "avenue", "boulevard": "boulevard", "boul": "boulevard",
    "bvd": "boulevard", "blvd": "boulevard", "bd": "boulevard", "bld": "boulevard", "chemin": "chemin", "chem": "chemin", "che": "chemin",
    "ch": "chemin", "chm": "chemin", "route": "route", "rte": "route", "place": "place", "pl": "place", "plc": "place", "allee": "allee", "allees": "allee",
    "all": "allee", "al": "allee", "impasse": "impasse", "imp": "impasse", "quai": "quai", "cours": "cours", "crs": "cours", "square": "square", "sq": "square",
    "passage": "passage", "pass": "passage", "esplanade": "esplanade", "esp": "esplanade", "street": "street", "road": "road", "rd": "road",
}
# Titles and other words within street and town names.
WORDS = {
    "st": "saint", "ste": "sainte", "dr": "docteur", "doct": "docteur", "pr": "professeur", "prof": "professeur", "gal": "general", "gen": "general",
    "gral": "general", "mal": "marechal", "cdt": "commandant", "cap": "capitaine", "pdt": "president", "s": "sur",
}
_LINKS = {"de", "du", "des", "d", "la", "le", "les", "l", "sur", "a"}
_KIND = "|".join(sorted(KINDS, key=len, reverse=True))
_NUMBER = re.compile(rf"\b(?:n[o°º]?\.? ?)?(\d{{1,4}}) ?(bis|ter|quater|[a-d])?[ ,]*[,-]?\s*(?=(?:{_KIND})\b)")
_STREET = re.compile(rf"(?:^|(?<=[\s,;|]))(?:(?:n[o°º]?\.? ?)?(\d{{1,4}}) ?(bis|ter|quater|[a-d])? )?({_KIND})\b\.?\s+(?!hospital)(.+)$")
_TAIL = re.compile(r"^(.*?)[ ,]+(?:n[o°º]?\.? ?)?(\d{1,4}) ?(bis|ter|quater|[a-d])?$")
_SPLIT = re.compile(r"\s*[;|\n\r,]\s*|\s+[-–—]\s+")
_POST = re.compile(r"(?:^|\s)(?:[a-z]{1,2}[- ])?(\d{5})\b")
_SKIP = re.compile(r"^(?:(?:umr|upr|ea|umr_s|bp|cs|tsa|po box|p\.? ?o\.? box)\b.*|\d+|cedex.*|)$")
_LAB = re.compile(r"^(?:lab|labo|laboratoires?|laboratory|dept|dep|departement|department|equipe|team|inst|institut|institute|faculte|fac|ufr|ecole|school|unite|service|umr)\b")
_ORG = re.compile(r"^(?:universite|univ|university|centre hospitalier|ctr hosp|chu|ch|hopital|centre hosp|c h)\b\.?\s*(?:universitaire\s+)?(?:de |d'|du |of )?\s*(.+)$")
_COUNTRY = {"france", "fr", "f", "fra"}


def _fold(text: str) -> str:
    text = "".join(c if unicodedata.category(c) != "Cf" else "" for c in text).replace("œ", "oe").replace("Œ", "oe")
    text = unicodedata.normalize("NFKD", text.replace("°", "o "))
    return "".join(c for c in text if not unicodedata.combining(c)).lower().replace("’", "'").replace("\xa0", " ")


def _name(text: str) -> str:
    """Words of a name, abbreviations written out, joining words left out."""
    words = [WORDS.get(w, w) for w in re.findall(r"[a-z0-9]+", text)]
    return " ".join(w for w in words if w not in _LINKS)


def _town(text: str) -> str:
    text = re.sub(r"\bcedex\b.*$|\bf-?(?=\s*\d{5})", " ", text)
    text = re.sub(r"\b(?:[a-z]{1,2}-)?\d{4,5}\b|\b\d+\b|\(.*?\)", " ", text)
    return _name(text)


def parse(text: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """(number, kind, street, town, postal code) of an address text; what it lacks is None.

    Laboratory, unit and post-box parts are left out. A town that is given only within the name of the
    institution is taken from there.
    """
    if not text or not text.strip():
        return None, None, None, None, None
    s = re.sub(r"[ \t]+", " ", _fold(text)).strip(" .")
    s = re.sub(r"\((?:umr|upr|ea|inserm|cnrs)[^)]*\)", " ", s)
    s = re.sub(r"\b(?:b\.?p\.?|cs|po box|boite postale) ?\d+\b", " ", s)
    s = _NUMBER.sub(lambda m: f"; {m.group(1)} {m.group(2) or ''} ".replace("  ", " "), s)
    number = kind = street = town = post = org = None
    for part in _SPLIT.split(s):
        part = re.sub(r" +", " ", part).strip(" .")
        if not part or part in _COUNTRY or _SKIP.match(part):
            continue
        if kind is None and (m := _STREET.search(part)) and not _LAB.match(part) and not _ORG.match(part[:0] + (part if not m.group(1) and m.start() == 0 and part.startswith(("ch hosp", "c h ")) else "")):
            kind, rest = KINDS[m.group(3)], m.group(4)
            number = (m.group(1) + (m.group(2) or "")) if m.group(1) else None
            if p := _POST.search(rest):  # the town follows without a separator
                post, town = p.group(1), _town(rest[p.end() :]) or None
                rest = rest[: p.start()]
            if number is None and (t := _TAIL.match(rest)):
                rest, number = t.group(1), t.group(2) + (t.group(3) or "")
            street = _name(rest) or None
            continue
        if m := _ORG.match(part):
            org = org or _town(m.group(1))
            continue
        if _LAB.match(part):
            continue
        if p := _POST.search(part):
            post = post or p.group(1)
            town = _town(part) or town
        elif town is None or not post:
            town = town or _town(part) or None
    if number:
        number = number.lstrip("0") or None
    return number, kind, street, town or org, post


def parsed(addresses: DataFrame, id_col: str = "id", text: str = "full_address") -> DataFrame:
    """(address_id, number, kind, street, town, post) of every row with a street and a town."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *parse(t)) for i, t in zip(pdf["address_id"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["address_id", "number", "kind", "street", "town", "post"])

    src = addresses.select(F.col(id_col).cast("bigint").alias("address_id"), F.col(text).alias("text"))
    return spread(src).mapInPandas(run, "address_id bigint, number string, kind string, street string, town string, post string")


def weighted_prefix_join(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of all pairs of ``items`` (id, blocks, grams) that share a block, with cosine >= ``threshold``, a < b.

    Grams weigh log(1 + N / count). In rarity order a vector keeps the shortest prefix after which the
    rest is shorter than the threshold; two vectors reach it only if their prefixes meet. Only ids and
    hashes go through the index; the grams that two vectors share, whose weights are the same on both
    sides, give the dot product, once a candidate. No candidate is lost, and a large block of the index is
    split over many tasks. Items without grams or blocks pair with nothing.
    """
    cut = Cut(items.sparkSession)
    g = items.select("id", F.explode(F.array_distinct("grams")).alias("g"))
    total = items.agg(F.count(F.lit(1)).alias("n"))
    df = g.groupBy("g").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(total))  # one row
    w = g.join(df.select("g", "c", F.pow(F.log1p(F.col("n") / F.col("c")), 2).alias("w")), "g")
    vec = w.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", F.xxhash64("g").alias("g"), "w"))).alias("v"))
    vec = vec.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"]))
    # How many grams until the squares of the rest fall below the squared threshold.
    least = F.lit(threshold * threshold) * F.col("square") - 1e-9
    keep = F.aggregate(
        "v",
        F.struct(F.col("square").alias("rest"), F.lit(0).alias("n")),
        lambda s, x: F.struct((s["rest"] - x["w"]).alias("rest"), F.when(s["rest"] >= least, s["n"] + 1).otherwise(s["n"]).alias("n")),
        lambda s: s["n"],
    )
    vec = cut(vec.select("id", F.transform("v", lambda x: F.struct(x["g"].alias("g"), x["w"].alias("w"))).alias("v"), F.sqrt("square").alias("norm"), keep.alias("keep")))
    pre = vec.join(items.select("id", F.explode(F.array_distinct("blocks")).alias("block")), "id")
    pre = pre.select("id", F.explode(F.transform(F.slice("v", F.lit(1), F.col("keep")), lambda x: F.xxhash64(F.col("block"), x["g"]))).alias("key"))
    live = pre.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    pre = cut(pre.join(live, "key"))
    cand = class_pairs(pre, "key", "id").select("a", "b").distinct()
    side = lambda n: vec.select(F.col("id").alias(n), F.col("v").alias(f"{n}v"), F.col("norm").alias(f"{n}n"))
    dot = F.aggregate(F.array_intersect("av", "bv"), F.lit(0.0), lambda s, x: s + x["w"]) / (F.col("an") * F.col("bn"))
    out = cut(cand.join(side("a"), "a").join(side("b"), "b").select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= threshold - 1e-12))
    cut.drop(vec, pre)
    return out


def _grams(c: Column) -> Column:
    """Trigrams of a name without its blanks, its ends marked."""
    t = F.concat(F.lit("^"), F.replace(c, F.lit(" "), F.lit("")), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))


def same_street(street_a: str, town_a: str, post_a: str | None, street_b: str, town_b: str, post_b: str | None) -> bool:
    """Whether two spellings can be one street of one town: words apart by typing errors only."""
    most = lambda x: 2 if len(x) >= 8 else 1 if len(x) >= 4 else 0
    if (street_a.isdigit() or street_b.isdigit()) and street_a != street_b:
        return False
    if _osa(street_a, street_b, 2) > min(most(street_a), most(street_b)):
        return False
    if town_a == town_b:
        return True
    return _osa(town_a, town_b, 2) <= min(most(town_a), most(town_b)) and (post_a is None or post_b is None or post_a == post_b or _osa(post_a, post_b, 1) <= 1)


def places(spark: SparkSession, addresses: DataFrame, id_col: str = "id", text: str = "full_address") -> DataFrame:
    """(address_id, place_id) of every address whose place is known; place_id is the smallest address id of the place.

    Rows without street or town have no place. A row without number belongs to the only number known
    in its street; where several are known it has no place.
    """
    cut = Cut(spark)
    p = cut(parsed(addresses, id_col, text).where("street is not null and town is not null and kind is not null"))
    key = F.xxhash64("kind", "street", "town")
    spell = cut(p.groupBy("kind", "street", "town").agg(F.mode("post", True).alias("post")).withColumn("id", key))
    # Streets meet in their town or postal code; towns meet in their street, also where it has one letter less.
    within = F.array_compact(F.array(F.concat_ws("|", F.lit("t"), "kind", "town"), F.when(F.col("post").isNotNull(), F.concat_ws("|", F.lit("p"), "kind", "post"))))
    less = F.transform(F.sequence(F.lit(1), F.length("street")), lambda i: F.concat(F.substring(F.col("street"), F.lit(1), i - 1), F.substring(F.col("street"), i + 1, F.length("street"))))
    named = F.transform(F.array_append(F.when(F.length("street") >= 5, less).otherwise(F.array().cast("array<string>")), F.col("street")), lambda x: F.concat_ws("|", "kind", x))
    pairs = weighted_prefix_join(spell.select("id", within.alias("blocks"), _grams(F.col("street")).alias("grams")), STREET_COSINE).unionByName(
        weighted_prefix_join(spell.select("id", named.alias("blocks"), _grams(F.col("town")).alias("grams")), TOWN_COSINE)
    ).select("a", "b").distinct()

    @F.pandas_udf("boolean")
    def same(sa: pd.Series, ta: pd.Series, pa: pd.Series, sb: pd.Series, tb: pd.Series, pb: pd.Series) -> pd.Series:
        none = lambda x: None if x is None or x != x else x
        return pd.Series([same_street(a, b, none(c), d, e, none(f)) for a, b, c, d, e, f in zip(sa, ta, pa, sb, tb, pb)], dtype=bool)

    side = lambda n: spell.select(F.col("id").alias(n), F.col("street").alias(f"s{n}"), F.col("town").alias(f"t{n}"), F.col("post").alias(f"p{n}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(same("sa", "ta", "pa", "sb", "tb", "pb")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    street = spell.select("id").join(connected_components(spark, links).withColumnRenamed("node", "id"), "id", "left")
    street = street.select(F.col("id").alias("sid"), F.coalesce("label", "id").alias("street_id"))
    rows = cut(p.withColumn("sid", key).join(street, "sid").select("address_id", "number", "street_id"))
    known = rows.groupBy("street_id").agg(F.count_distinct("number").alias("n"), F.max("number").alias("only"))
    rows = lookup(rows, known, "street_id").where("number is not null or n <= 1")
    rows = rows.select("address_id", "street_id", F.coalesce("number", "only", F.lit("")).alias("number"))
    rows = cut(rows.withColumn("at", F.xxhash64("street_id", "number")).select("address_id", "at"))
    return cut.keep(lookup(rows, rows.groupBy("at").agg(F.min("address_id").alias("place_id")), "at").select("address_id", "place_id"))


def p7_places(spark: SparkSession, base: str) -> DataFrame:
    """One row for each address with a known place: (address_id, place_id, addresses)."""
    pl = places(spark, table(spark, base, "addresses"))
    return lookup(pl, pl.groupBy("place_id").agg(F.count(F.lit(1)).alias("addresses")), "place_id").select("address_id", "place_id", "addresses")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return class_pairs(places(spark, table(spark, base, "addresses")), "place_id", "address_id").select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))
