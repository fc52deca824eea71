"""Problem 5: variant spellings of names typed by people.

Every name is rewritten by rules (titles and years away, nicknames to full names, legal forms of groups
away, token order and joined tokens ignored, initials) and exploded into its canonical forms, those with
one letter less of the family or the given name included. Which tokens are given names is learnt from the
order and the capitals of the names as signed. Names meet by an equi-join on forms and are scored by the
rarity of the rewriting they share: a pair that differs is one person only if fewer than one other would
be expected to share family form and given name by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.text import unaccent
from corvina.llm.canonical import _osa
from corvina.operators.graph import class_pairs, connected_components, lookup, star_edges
from corvina.session import Cut, spread, table

#: Signatures without evidence that every token starts with: a given name needs more than half of all and these.
DOUBT = 2
# Nicknames and short forms, and the given name meant.
NICKNAMES = {
    "alex": "alexandre", "sacha": "alexandre", "toni": "antoine", "tonio": "antoine", "ben": "benjamin", "benji": "benjamin", "cathy": "catherine",
    "kate": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christophe", "dan": "daniel", "danny": "daniel", "dom": "dominique",
    "domi": "dominique", "ed": "edouard", "eddy": "edouard", "babette": "elisabeth", "liz": "elisabeth", "beth": "elisabeth", "lise": "elisabeth", "milie": "emilie",
    "mimi": "emilie", "paco": "francisco", "pancho": "francisco", "fred": "frederic", "gaby": "gabriel", "gabi": "gabriel", "gege": "gerard", "gunni": "gunther",
    "riton": "henri", "harry": "henri", "nacho": "ignacio", "inga": "ingrid", "isa": "isabelle", "jack": "jacques", "jacky": "jacques", "joe": "joseph", "jo": "joseph",
    "jojo": "joseph", "pepe": "jose", "kasia": "katarzyna", "kader": "abdelkader", "lulu": "lucien", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "mat": "mathieu", "matt": "mathieu", "mike": "michael", "mick": "michael", "micha": "michael", "nath": "nathalie", "nat": "nathalie", "nico": "nicolas", "nick": "nicolas",
    "pat": "patrick", "pati": "patricia", "patty": "patricia", "trish": "patricia", "raph": "raphael", "rob": "robert", "bob": "robert", "bobby": "robert", "dick": "richard",
    "rick": "richard", "richie": "richard", "sam": "samuel", "sammy": "samuel", "soso": "sophie", "steph": "stephane", "stef": "stephane", "theo": "theodore", "ted": "theodore",
    "tom": "thomas", "tommy": "thomas", "vero": "veronique", "vic": "viktor", "bill": "william", "will": "william", "willy": "william", "billy": "william", "xav": "xavier",
    "uschi": "ursula", "lukas": "lukasz", "luc": "luc", "quent": "quentin", "marilene": "marie helene", "leilou": "leila", "olia": "olga", "ula": "ursula", "wandzia": "wanda",
    "ossi": "oscar", "yvy": "yvonne", "zozo": "zoe", "karimo": "karim", "soeren": "soren", "vicky": "viktor",
}
# Words beside a name that are no part of it.
TITLES = {"dr", "phd", "prof", "pr", "professeur", "docteur", "m", "mr", "mme", "mrs", "ms", "md", "jr", "sr", "msc", "ing", "mlle"}
# Words of legal and group forms.
GROUPS = {"collaboration", "collaborations", "collab", "consortium", "group", "groupe", "team", "equipe", "network", "reseau", "study", "investigators", "committee", "comite"}
GROUP_JOINING = {"on", "behalf", "of", "the", "for", "and", "les", "le", "du", "de", "la", "and", "au", "nom"}
PARTICLES = {"de", "la", "le", "du", "des", "van", "von", "der", "den", "el", "al", "saint", "st", "ben", "di", "da", "del", "d", "l"}
# Words that stand for no name.
NO_NAME = {"", "et al", "anonymous", "anonyme", "unknown", "n a", "inconnu", "none", "null", "na"}


#: What is known of a token: it is a given name; the given names within an edit, most usual first; it is two given names in one.
Info = dict[str, tuple[bool, list[str], bool]]
UNKNOWN: tuple[bool, list[str], bool] = (False, [], False)


def rewrite(name: str | None, info: Info) -> tuple[str, str, str, str, str] | None:
    """(kind, family, family with sorted tokens, family with particles, given) of a normalised name, None if it names nobody.

    kind is ``p`` or ``g`` (group). The family name is joined without blanks; given is the full given
    name, or the initials in upper case if no full one stands there.
    """
    text = re.sub(r"[^a-z0-9]+", " ", (name or "").lower()).strip()
    if text in NO_NAME:
        return None
    tokens = text.split()
    if any(t in GROUPS for t in tokens):
        rest = [t for t in tokens if t not in GROUPS and t not in GROUP_JOINING]
        return ("g", "".join(rest), "".join(sorted(rest)), "".join(rest), "") if rest else None
    tokens = [t for t in tokens if not t.isdigit() and (t not in TITLES or t == "m")] or tokens
    full, short, family = _sort_tokens(tokens, info)
    if (mended := mend(" ".join(tokens))) != " ".join(tokens):
        other = _sort_tokens(mended.split(), info)  # an accented letter that was garbled, then folded
        if other[2] and len(other[0]) > len(full):
            full, short, family = other
    if not family:
        if len(full) < 2:
            return None
        family, full = [full[-1]], full[:-1]
    if not full and not short:
        if len(family) < 2:
            return "p", "".join(family), "".join(family), "".join(family), ""
        full, family = [family[0]], family[1:]
    first = "".join(full) if full else "".join(short).upper()
    glued = [t for t in tokens if t in family or (t in PARTICLES and len(t) > 1)] if all(t in tokens for t in family) else family
    return "p", sounds("".join(family)), sounds("".join(mend(" ".join(sorted(family))).split())), sounds("".join(glued)), first


def mend(text: str) -> str:
    """Accented letters that were garbled and then folded (``a`` and a blank, ``a1 4``), as the likeliest plain letter."""
    return re.sub(r"a (?=[a-z])", "e", text.replace("a1 4", "u")) if " " in text else text


def sounds(text: str) -> str:
    """One spelling for letters that sound alike."""
    return text.replace("ph", "f")


def _near(t: str, info: Info) -> str | None:
    """The given name that a mistyped token is likely meant for: one edit off, or two from seven letters on."""
    known = info.get(t, UNKNOWN)[1]
    return next((g for g in known if _osa(t, g, 1) <= 1), None) or next((g for g in known if len(t) >= 7 and _osa(t, g, 2) <= 2), None)


def _sort_tokens(tokens: list[str], info: Info) -> tuple[list[str], list[str], list[str]]:
    """Given names (in full), initials and family tokens; a mistyped given name is taken for the most usual one an edit off."""
    given = lambda t: t in NICKNAMES or info.get(t, UNKNOWN)[0]
    full, short, other = [], [], []
    for t in tokens:
        if t in PARTICLES and len(t) > 1 and (t != "ben" or len(tokens) > 2):
            continue
        if len(t) == 1:
            short.append(t)
        elif len(t) == 2 and not given(t) and not set(t) & set("aeiouy"):
            short += t  # the initials of a double given name
        elif given(t):
            full += NICKNAMES.get(t, t).split()
        else:
            other.append(t)
    if not full and len(other) > 1:
        for k, t in enumerate(other):
            if len(t) >= 3 and (near := _near(t, info)):
                full.append(near)
                other = other[:k] + other[k + 1 :]
                break
    if len(full) == 1 and len(other) > 1:  # the second part of a double given name, mistyped
        for k, t in enumerate(other):
            if len(t) >= 5 and (near := _near(t, info)) and len(near) >= 5 and _osa(t, near, 1) <= 1:
                full = full + [near] if tokens.index(t) > 0 else [near] + full
                other = other[:k] + other[k + 1 :]
                break
    if not full and len(other) > 1:  # a double given name written as one
        for k, t in enumerate(other):
            if info.get(t, UNKNOWN)[2]:
                full.append(t)
                other = other[:k] + other[k + 1 :]
                break
    return full, short, other


def one_less(text: str, least: int = 3) -> set[str]:
    """``text`` without each of its letters in turn: two words at most one edit or swap apart share such a form."""
    return {text[:k] + text[k + 1 :] for k in range(len(text))} if len(text) >= least else set()


def given_names(signed: DataFrame) -> DataFrame:
    """(t, n) of the tokens that are given names: signed as such beside more than half of the tokens that they
    stand beside, ``DOUBT`` more counted against them.

    ``signed``: raw, a name as signed. What follows a comma is given; else what isn't in capitals beside a
    word that is; else the first token is given and the last is not. Names of groups, initials and names with
    signs that no name has (garbled ones) tell nothing.
    """
    fold = lambda c: F.filter(F.split(F.trim(F.regexp_replace(unaccent(c), r"[^a-z]+", " ")), " "), lambda t: (F.length(t) > 1) & ~t.isin(*TITLES, *PARTICLES))
    raw = F.col("raw")
    caps = r"(?<!\p{L})(\p{Lu}[\p{Lu}'’-]+)(?!\p{L})"
    none = F.array().cast("array<string>")
    words = fold(raw)
    upper = fold(F.array_join(F.regexp_extract_all(raw, F.lit(caps), 1), " "))
    mixed = (F.size(upper) > 0) & (F.size(upper) < F.size(words))
    comma = F.contains(raw, F.lit(","))
    left, right = fold(F.split_part(raw, F.lit(","), F.lit(1))), fold(F.regexp_replace(raw, r"^[^,]*,", " "))
    g = F.when(comma, right).when(mixed, F.array_except(words, upper)).when(F.size(words) > 1, F.slice(words, 1, 1)).otherwise(none)
    f = F.when(comma, left).when(mixed, upper).when(F.size(words) > 1, F.slice(words, -1, 1)).otherwise(none)
    s = signed.where(F.col("raw").isNotNull() & ~F.col("raw").rlike(r"[^\p{L}\p{M}\s\u00a0\d,.()'’‐-]")).select("raw").distinct().select(words.alias("words"), g.alias("g"), f.alias("f"))
    s = s.where((F.size("g") > 0) & (F.size("f") > 0) & ~F.arrays_overlap("words", F.array(*map(F.lit, sorted(GROUPS)))))
    beside = lambda own, other, g: F.transform(own, lambda t: F.struct(t.alias("t"), F.col(other)[0].alias("o"), F.lit(g).alias("g")))
    e = s.select(F.explode(F.concat(beside("g", "f", 1), beside("f", "g", 0))).alias("e")).distinct()
    n = e.groupBy("e.t").agg(F.sum("e.g").alias("g"), F.count(F.lit(1)).alias("n"))
    return n.where(F.col("g") * 2 > F.col("n") + DOUBT).select("t", "n")


def token_info(tokens: DataFrame, given: DataFrame) -> DataFrame:
    """(t, given, near, double) of each distinct token of ``tokens`` (t) that is a given name, near one, or two in one.

    Tokens meet given names on forms with one letter less, of which each form keeps its most usual name;
    so the lookup is an index, linear in the vocabulary.
    """
    nick = sorted({w for g in NICKNAMES.values() for w in g.split()})
    always = tokens.sparkSession.createDataFrame([(w, 1) for w in nick], "t string, n bigint")
    given = given.unionByName(always).groupBy("t").agg(F.sum("n").alias("n"))
    forms = lambda df: df.withColumn("f", F.explode(F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring(F.col("t"), i + 1, F.length("t")))), F.col("t")))))
    best = forms(given.where(F.length("t") >= 3)).groupBy("f").agg(F.max(F.struct("n", F.col("t").alias("g"))).alias("b"))
    rest = tokens.join(given, "t", "left_anti")
    near = forms(rest.where(F.length("t") >= 3)).join(best, "f").groupBy("t").agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("b.n")).alias("n"), F.col("b.g").alias("g")))), lambda x: x["g"]).alias("near"))
    split = rest.where(F.length("t") >= 5).select("t", F.explode(F.sequence(F.lit(2), F.length("t") - 2)).alias("i")).select("t", F.substring(F.col("t"), F.lit(1), F.col("i")).alias("a"), F.substring(F.col("t"), F.col("i") + 1, F.length("t")).alias("b"))
    double = split.join(given.select(F.col("t").alias("a")), "a").join(given.select(F.col("t").alias("b")), "b").select("t").distinct().withColumn("double", F.lit(True))
    out = tokens.join(given.select("t").withColumn("given", F.lit(True)), "t", "left").join(near, "t", "left").join(double, "t", "left")
    return out.where("given or near is not null or double").select("t", F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("near", F.array().cast("array<string>")).alias("near"), F.coalesce("double", F.lit(False)).alias("double"))


def _first_compatible(a: str, b: str) -> bool:
    """Whether two given parts can be one: equal or one edit apart in full, or an initial of the other."""
    if not a or not b:
        return a == b
    if a.isupper() or b.isupper():
        return a[0].lower() == b[0].lower()
    return a == b or (min(len(a), len(b)) >= 5 and _osa(a, b, 1) <= 1)


def person_classes(spark: SparkSession, keys: DataFrame, forms: DataFrame | None = None, signed: DataFrame | None = None) -> DataFrame:
    """(identity_id, class_id) of every row with a name; class_id is the smallest identity of the class.

    ``keys``: id, author_name_normalized, person_identifiers. Rows that share an ``orcid`` or a
    ``researcher_id`` are one person. Different ``orcid`` values are different persons: a class with
    several is split by them, and its rows without any stay with the one of their spelling, or alone if
    that spelling has several. Initials join the only full name they fit.
    ``forms``: name_form, person_id, status; spellings of one person that were not rejected are linked.
    ``signed``: raw_author_name, the names as signed, from which given names are learnt, else from ``keys``.
    """
    cut = Cut(spark)
    m = F.from_json(F.col("person_identifiers"), "map<string,string>")
    rows = keys.select(
        F.col("id").cast("bigint").alias("id"), F.lower("author_name_normalized").alias("name"),
        F.nullif(F.upper(F.trim(m["orcid"])), F.lit("")).alias("orcid"), F.nullif(F.trim(m["researcher_id"]), F.lit("")).alias("rid"),
    ).where("id is not null and name is not null")
    distinct = rows.select("name").distinct()
    if forms is not None:
        curated = forms.where("person_id is not null and coalesce(status, '') <> 'rejected'").select(F.lower("name_form").alias("name"), "person_id")
        distinct = distinct.unionByName(curated.select("name").where("name is not null")).distinct()
    distinct = cut(distinct)
    raw = distinct.select(F.col("name").alias("raw")) if signed is None else signed.select(F.col("raw_author_name").alias("raw"))
    mended = F.regexp_replace(F.replace("name", F.lit("a1 4"), F.lit("u")), "a (?=[a-z])", "e")
    words = distinct.select("name", F.explode(F.array_distinct(F.concat(F.split(F.trim(F.regexp_replace("name", "[^a-z0-9]+", " ")), " "), F.split(F.trim(F.regexp_replace(mended, "[^a-z0-9]+", " ")), " ")))).alias("t"))
    words = cut(words)
    info = cut(token_info(cut(words.select("t").distinct()), cut(given_names(raw))))
    told = words.join(info, "t").groupBy("name").agg(F.collect_list(F.struct("t", "given", "near", "double")).alias("info"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for name, told in zip(pdf["name"], pdf["info"]):
                info = {} if told is None else {x["t"]: (x["given"], list(x["near"]), x["double"]) for x in told}
                if r := rewrite(name, info):
                    got.append((name, *r))
            yield pd.DataFrame(got, columns=["name", "kind", "family", "family2", "family3", "first"])

    core_key = F.xxhash64("kind", "family2", "first")
    parsed = cut(spread(distinct.join(told, "name", "left")).mapInPandas(parse, "name string, kind string, family string, family2 string, family3 string, first string").where("family <> ''").withColumn("core", core_key))
    cores = cut(parsed.groupBy("core").agg(F.first("kind").alias("kind"), F.min("family").alias("family"), F.min("family2").alias("family2"), F.min("family3").alias("family3"), F.first("first").alias("first")))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, kind, f, f2, f3, first in pdf.itertuples(index=False):
                for form in {f, f2, f3} | one_less(f) | one_less(f2):
                    out.append((c, f"{kind}|{form}|{first[:1].lower()}"))
                if first and not first.isupper():  # the given name mistyped, its first letter too
                    out += [(c, f"{kind}|{f}|-{less}") for less in one_less(first, 5)]
            yield pd.DataFrame(out, columns=["core", "form"])

    shapes = cut(spread(cores.select("core", "kind", "family", "family2", "family3", "first")).mapInPandas(explode, "core bigint, form string"))
    rarity = shapes.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(class_pairs(cut(shapes.join(rarity, "form")), "form", "core"))
    met = met.join(rarity.withColumnRenamed("form", "c"), "c").groupBy("a", "b").agg(F.min("n").alias("n"))  # of the rarest form they share
    total = cores.agg(F.count(F.lit(1)).alias("total"))  # one row
    usual = cores.groupBy("first").agg(F.count(F.lit(1)).alias("u"))
    known = cut(lookup(cores, usual, "first"))
    side = lambda x: known.select(F.col("core").alias(x), F.col("family").alias(f"f{x}"), F.col("family2").alias(f"g{x}"), F.col("family3").alias(f"k{x}"), F.col("first").alias(f"h{x}"), F.col("u").alias(f"u{x}"))

    @F.pandas_udf("int")
    def verify(fa: pd.Series, ga: pd.Series, ka: pd.Series, ha: pd.Series, fb: pd.Series, gb: pd.Series, kb: pd.Series, hb: pd.Series) -> pd.Series:
        """Edits between the families, -1 if they or the given names can't be one; short families need the same full given name."""

        def one(fa, ga, ka, ha, fb, gb, kb, hb):
            if not _first_compatible(ha, hb):
                return -1
            if fa == fb or ga == gb or ka == kb:
                return 0
            if min(len(fa), len(fb)) < 5 and (ha != hb or ha.isupper() or not ha):
                return -1
            return 1 if min(_osa(fa, fb, 1), _osa(ga, gb, 1)) <= 1 else -1

        return pd.Series([one(*x) for x in zip(fa, ga, ka, ha, fb, gb, kb, hb)], dtype="int32")

    # Others expected to share the rewriting and the given name by chance, an edit counting as much rarer evidence.
    chance = F.col("n") * F.least("ua", "ub") / F.col("total")
    same = (F.col("edits") == 0) & (F.col("ha") == F.col("hb"))
    pairs = cut(met).join(side("a"), "a").join(side("b"), "b").withColumn("edits", verify("fa", "ga", "ka", "ha", "fb", "gb", "kb", "hb")).where("edits >= 0")
    initials = (F.col("ha") == F.upper("ha")) | (F.col("hb") == F.upper("hb"))
    pairs = cut(pairs.crossJoin(F.broadcast(total)).where(same | initials | (chance < 1)).select("a", "b", "ha", "hb", "edits", chance.alias("chance")))
    initial = lambda c: (F.col(c) == F.upper(c)) & (F.col(c) != "")
    full = pairs.where(~initial("ha") & ~initial("hb")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    with_core = rows.join(parsed.select("name", "core"), "name")
    known = with_core.select("core", F.explode(F.array_compact(F.array(F.concat(F.lit("o:"), "orcid"), F.concat(F.lit("r:"), "rid")))).alias("k")).distinct()
    strong = star_edges(known, "core", "k")
    if forms is not None:
        one = curated.join(parsed.select("name", "core"), "name").select("core", F.col("person_id").cast("string").alias("k")).distinct()
        strong = strong.unionByName(star_edges(one, "core", "k"))
    edges = cut(full.unionByName(strong))
    sure = connected_components(spark, edges).withColumnRenamed("node", "core")
    label = cut(cores.select("core").join(sure, "core", "left").select("core", F.coalesce("label", "core").alias("label")))
    # Initials: the only class of full names they fit, first with the same family name, then one edit off.
    fits = pairs.where(initial("ha") & ~initial("hb")).select(F.col("a").alias("core"), F.col("b").alias("to"), "edits").unionByName(
        pairs.where(initial("hb") & ~initial("ha")).select(F.col("b").alias("core"), F.col("a").alias("to"), "edits")
    )
    best = fits.join(label.withColumnRenamed("core", "to"), "to").groupBy("core", "edits").agg(F.count_distinct("label").alias("n"), F.min("to").alias("to"))
    best = best.groupBy("core").agg(F.min(F.struct("edits", "n", "to")).alias("b")).select("core", "b.n", "b.to")
    attach = best.where("n = 1").select(F.col("core").alias("src"), F.col("to").alias("dst"))
    loose = pairs.where(initial("ha") & initial("hb")).join(best.where("n > 1").select(F.col("core").alias("a")), "a", "left_anti").join(best.where("n > 1").select(F.col("core").alias("b")), "b", "left_anti")
    final = connected_components(spark, cut(edges.unionByName(attach).unionByName(loose.select(F.col("a").alias("src"), F.col("b").alias("dst"))))).withColumnRenamed("node", "core")
    placed = cut(with_core.join(final, "core", "left").select("id", "core", F.coalesce("label", "core").alias("label"), "orcid"))
    ids = placed.where("orcid is not null")
    of_label = ids.groupBy("label").agg(F.count_distinct("orcid").alias("n"))
    of_core = ids.groupBy("label", "core").agg(F.count_distinct("orcid").alias("cn"), F.min("orcid").alias("co"))
    split = cut(lookup(placed, of_label, "label")).join(of_core, ["label", "core"], "left")
    part = (
        F.when(F.coalesce("n", F.lit(0)) <= 1, F.lit(""))
        .when(F.col("orcid").isNotNull(), F.col("orcid"))
        .when(F.col("cn") == 1, F.col("co"))
        .otherwise(F.concat(F.lit("row "), F.col("id").cast("string")))
    )
    split = cut(split.select("id", F.xxhash64("label", part).alias("at")))
    ids = split.groupBy("at").agg(F.min("id").alias("class_id"))
    return cut.keep(lookup(split, ids, "at").select(F.col("id").alias("identity_id"), "class_id"))


def _classes(spark: SparkSession, base: str) -> DataFrame:
    return person_classes(spark, table(spark, base, "author_identifying_keys"), table(spark, base, "person_name_forms"), table(spark, base, "source_authorships"))


def p5_classes(spark: SparkSession, base: str) -> DataFrame:
    """One row for each identity with a name: (identity_id, class_id, identities)."""
    c = _classes(spark, base)
    return lookup(c, c.groupBy("class_id").agg(F.count(F.lit(1)).alias("identities")), "class_id").select("identity_id", "class_id", "identities")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return class_pairs(_classes(spark, base), "class_id", "identity_id").select(F.col("a").alias("identity_id_a"), F.col("b").alias("identity_id_b"))
