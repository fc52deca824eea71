"""Person matching, set-based: rungs are DataFrames, the strongest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.names import compatible, name_tokens, names_compatible, one_short, parse_name, same_person, within_one_edit
from corvina.operators.aggregates import consensus
from corvina.operators.graph import class_pairs

#: The rungs in order of strength, by the reason a match gets.
RUNGS = ("orcid", "hal_person_id", "idref", "single_name", "cross_source")
# Sources whose ORCIDs were deposited by the author.
ORCID_SOURCES = ("crossref", "openalex", "hal")


def unique_person(candidates: DataFrame, sig: str, rung: str, rejected: DataFrame | None = None) -> DataFrame:
    """(sig, person_id, rung) of signatures with exactly one candidate once rejected pairs are gone."""
    c = candidates.select(sig, "person_id").where("person_id is not null").distinct()
    if rejected is not None:
        c = c.join(rejected.select(sig, "person_id"), [sig, "person_id"], "left_anti")
    n = c.groupBy(sig).agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("person_id")).where("n = 1")
    return n.select(sig, "person_id", F.lit(rung).alias("rung"))


def cascade(rungs: list[DataFrame], sig: str) -> DataFrame:
    """(sig, person_id, rung): the strongest rung that decides; ``rungs`` in order of strength."""
    out = None
    for i, r in enumerate(rungs):
        r = r.withColumn("__k", F.lit(i))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(sig).agg(F.min(F.struct("__k", "person_id", "rung")).alias("m")).select(sig, "m.person_id", "m.rung")


def without_rejected(candidates: DataFrame, sigs: DataFrame, sig: str, rejected: DataFrame | None) -> DataFrame:
    """Candidates (sig, person_id) less the persons that were rejected for the signature's publication (publication_id, person_id)."""
    if rejected is None:
        return candidates
    r = sigs.select(sig, "publication_id").join(rejected.select("publication_id", "person_id").distinct(), "publication_id").select(sig, "person_id")
    return candidates.join(r, [sig, "person_id"], "left_anti")


def identifier_rung(sigs: DataFrame, sig: str, value: str, owners: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(sig, person_id, accepted) of signatures whose identifier has an owner; accepted once the name corroborates it.

    A verdict on (name, person) decides: confirmed accepts, rejected refuses; without one the two names must be
    of one person, spelling apart. A signature without a name isn't corroborated.
    ``sigs``: sig, value, raw_name, name; ``owners``: value, person_id, last, first; ``verdicts``: name_form, person_id, status.
    """
    o = owners.where(F.col("value").isNotNull()).groupBy("value").agg(F.min(F.struct("person_id", "last", "first")).alias("o")).select(F.col("value").alias(value), "o.person_id", F.col("o.last").alias("__l"), F.col("o.first").alias("__f"))
    v = verdicts.where("status in ('confirmed', 'rejected')").groupBy(F.col("name_form").alias("name"), "person_id").agg(F.min("status").alias("__v"))
    j = sigs.select(sig, value, "raw_name", "name").join(o, value).join(v, ["name", "person_id"], "left")
    n = parse_name(F.col("raw_name"))
    alike = same_person(F.coalesce(n["last"], F.lit("")), F.coalesce(n["first"], F.lit("")), F.coalesce("__l", F.lit("")), F.coalesce("__f", F.lit("")))
    accepted = F.when(F.col("__v") == "confirmed", True).when(F.col("__v") == "rejected", False).otherwise(F.coalesce(alike, F.lit(False)))
    return j.select(sig, "person_id", accepted.alias("accepted"))


def name_form_rung(sigs: DataFrame, sig: str, name: str, forms: DataFrame) -> DataFrame:
    """The person of the only form a name has, links marked rejected left out."""
    f = forms.where("status <> 'rejected'").select(F.col("name_form").alias(name), "person_id").distinct()
    return unique_person(sigs.select(sig, name).join(f, name), sig, "name_form")


def name_outcome(sigs: DataFrame, sig: str, forms: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(sig, action, person_id, reason) of the name alone, for signatures inside the perimeter; others are skipped.

    One person left once those rejected for the publication are gone: match. A known form with none or several
    left: skip. An unknown form: create, unless it signs a thesis without being its author.
    ``sigs``: sig, name, publication_id, in_perimeter, source, roles; ``forms``: name_form, person_id, status.
    """
    f = forms.where("coalesce(status, '') <> 'rejected' and person_id is not null and name_form is not null").select(F.col("name_form").alias("name"), "person_id").distinct()
    inside = sigs.where(F.coalesce("in_perimeter", F.lit(False)))
    left = without_rejected(inside.select(sig, "name").join(f, "name").select(sig, "person_id"), sigs, sig, rejected)
    n = left.groupBy(sig).agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id"))
    known = f.select("name").distinct().withColumn("known", F.lit(True))
    j = inside.select(sig, "name", "source", "roles").join(known, "name", "left").join(n, sig, "left")
    may = ~((F.col("source") == "theses") & ~F.coalesce(F.array_contains("roles", "author"), F.lit(False)))
    action = F.when(F.col("n") == 1, "match").when(F.col("known"), "skip").when(may, "create").otherwise("skip")
    reason = F.when(F.col("n") == 1, "single_name").when(F.col("known"), "ambiguous_name_form").when(may, "new").otherwise("creation_not_allowed")
    out = j.select(sig, action.alias("action"), F.when(F.col("n") == 1, F.col("person_id")).alias("person_id"), reason.alias("reason"))
    outside = sigs.where(~F.coalesce("in_perimeter", F.lit(False))).select(sig, F.lit("skip").alias("action"), F.lit(None).cast("bigint").alias("person_id"), F.lit("out_of_perimeter").alias("reason"))
    return out.unionByName(outside)


def cross_source_rung(sigs: DataFrame, sig: str) -> DataFrame:
    """Persons of other sources' signatures at the same publication and position with a compatible name.

    ``sigs``: sig, source, publication_id, author_position, name, person_id.
    """
    todo = sigs.where("person_id is null").select(sig, "source", "publication_id", "author_position", "name")
    have = sigs.where("person_id is not null").select(F.col("source").alias("s2"), "publication_id", "author_position", F.col("name").alias("n2"), "person_id")
    c = todo.join(have, ["publication_id", "author_position"]).where("source <> s2").where(names_compatible(F.col("name"), F.col("n2")))
    return unique_person(c, sig, "cross_source")


def match_persons(sigs: DataFrame, owners: dict[str, DataFrame], forms: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(id, action, person_id, reason, new_key) of every signature without a person.

    Rungs from the strongest: ORCID (of sources whose authors deposit it), HAL account, IdRef, each corroborated
    by the name; the only person of the name form; a signature of another source at the same place with a
    compatible name; else a new person, one for each name form (``new_key``). A person rejected for the
    publication is no match on any rung. Signatures matched on a firm rung are anchors of the cross-source
    one, whatever their order; what is created is decided last, so it can still join such an anchor.
    ``sigs``: id, source, publication_id, author_position, name, raw_name, in_perimeter, roles, person_id and one column
    for each kind of ``owners`` (orcid, hal_person_id, idref); ``owners``: value, person_id, last, first by kind.
    """
    todo = sigs.where("person_id is null")
    firm = []
    for kind in (k for k in RUNGS if k in owners):
        s = todo.where(F.col("source").isin(*ORCID_SOURCES)) if kind == "orcid" else todo
        hit = identifier_rung(s.where(F.col(kind).isNotNull()), "id", kind, owners[kind], forms).where("accepted").select("id", "person_id")
        firm.append(unique_person(without_rejected(hit, todo, "id", rejected), "id", kind))
    names = name_outcome(todo, "id", forms, rejected)
    firm.append(names.where("action = 'match'").select("id", "person_id", F.col("reason").alias("rung")))
    sure = cascade(firm, "id")
    placed = sigs.drop("person_id").join(sure.select("id", F.col("person_id").alias("p1")), "id", "left").join(sigs.where("person_id is not null").select("id", F.col("person_id").alias("p0")), "id", "left")
    anchored = placed.withColumn("person_id", F.coalesce("p0", "p1"))
    cross = cross_source_rung(anchored, "id").select("id", "person_id")
    cross = without_rejected(cross, todo, "id", rejected).select("id", "person_id", F.lit("cross_source").alias("rung"))
    hit = cascade([sure, cross], "id").select("id", F.col("person_id").alias("p"), "rung")
    j = todo.select("id", "name").join(hit, "id", "left").join(names.select("id", "action", "reason"), "id", "left")
    action = F.when(F.col("p").isNotNull(), "match").when(F.col("action") == "create", "create").otherwise("skip")
    return j.select("id", action.alias("action"), F.col("p").alias("person_id"), F.coalesce("rung", "reason").alias("reason"), F.when(action == "create", F.col("name")).alias("new_key"))


def identifier_consensus(sigs: DataFrame, kind: str, value: str) -> DataFrame:
    """The person most signatures of an identifier are linked to."""
    return consensus(sigs.where(F.col(value).isNotNull()), [kind, value], "person_id")


def transfers(owned: DataFrame, agreed: DataFrame, keys: list[str]) -> DataFrame:
    """Identifiers whose consensus person is not their owner: (keys, from_person, to_person)."""
    a = agreed.select(*keys, F.col("person_id").alias("to_person"))
    return owned.select(*keys, F.col("person_id").alias("from_person")).join(a, keys).where("from_person <> to_person")


def identifier_conflicts(sigs: DataFrame, value: str, name: str) -> DataFrame:
    """(value, persons, names) of identifiers that signatures of two or more persons carry."""
    s = sigs.where(F.col(value).isNotNull() & F.col("person_id").isNotNull())
    g = s.groupBy(value).agg(F.array_sort(F.collect_set("person_id")).alias("persons"), F.array_sort(F.collect_set(name)).alias("names"))
    return g.where(F.size("persons") >= 2)


def mark_dubious(authors: DataFrame, record: str, ident: str, ids: str) -> DataFrame:
    """(ident, ids) with the keys of identifiers that two or more authors of one record carry suffixed ``_dubious``.

    ``ids``: map<string,string> of kind to value. A marked value is kept but no longer matches a person.
    """
    e = authors.select(record, ident, F.explode(ids).alias("k", "v")).where("v is not null")
    n = e.groupBy(record, "k", "v").agg(F.count_distinct(ident).alias("n")).where("n >= 2").select(record, "k", "v", F.lit("_dubious").alias("s"))
    out = e.join(n, [record, "k", "v"], "left").select(ident, F.concat("k", F.coalesce("s", F.lit(""))).alias("k"), "v")
    g = out.groupBy(ident).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(ids))
    return authors.select(ident).distinct().join(g, ident, "left")


def ambiguous_forms(forms: DataFrame) -> DataFrame:
    """(name_form, persons) of forms that two or more persons have."""
    n = forms.where("status <> 'rejected' and person_id is not null").groupBy("name_form").agg(F.count_distinct("person_id").alias("n"), F.array_sort(F.collect_set("person_id")).alias("persons"))
    return n.where("n >= 2").select("name_form", "persons")


def sync_forms(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name_form, person_id, action) between two indexes; decided statuses (not pending) keep a row alive."""
    o = old.select("name_form", "person_id", "status").groupBy("name_form", "person_id").agg(F.min("status").alias("status"))
    n = new.select("name_form", "person_id").distinct().withColumn("__n", F.lit(1))
    j = o.join(n, ["name_form", "person_id"], "full")
    action = F.when(F.col("status").isNull(), "insert").when(F.col("__n").isNotNull(), "keep").when(F.col("status") == "pending", "delete").otherwise("keep")
    return j.select("name_form", "person_id", action.alias("action"))


def dubious(authors: DataFrame, record: str, kind: str, value: str) -> DataFrame:
    """Identifiers that two or more authors of one record carry: (record, kind, value, n)."""
    return authors.where(F.col(value).isNotNull()).groupBy(record, kind, value).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def duplicate_persons(names: DataFrame, ident: str, name: str, apart: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b) with compatible names that share a word (two letters or more), whatever its frequency.

    Each token of the smaller name fits one of the larger, so the two meet by equality on a shared word and the
    first letter of one more token: the smaller gives one such token a word, the larger all of its tokens. Names
    are distinct before they meet and a hot word is cut by the letters beside it; AQE splits what stays skewed.
    Pairs marked as distinct (``apart``: id_a, id_b) are left out.
    """
    d = names.select(F.col(ident).alias("i"), F.col(name).alias("n")).where("n is not null").distinct()
    t = d.select("n").distinct().withColumn("t", name_tokens(F.col("n")))
    t = t.select("n", F.size("t").alias("z"), "t", F.posexplode("t").alias("p", "w")).where(F.length("w") >= 2)
    other = F.filter("t", lambda w, i: i != F.col("p"))
    small = t.select(F.col("n").alias("na"), F.col("z").alias("za"), F.col("t").alias("ta"), "w", F.substring(F.coalesce(F.get(other, 0), F.lit("")), 1, 1).alias("l")).distinct()
    letters = F.array_distinct(F.array_append(F.transform("t", lambda w: F.substring(w, 1, 1)), F.lit("")))
    large = t.select(F.col("n").alias("nb"), F.col("z").alias("zb"), F.col("t").alias("tb"), "w", F.explode(letters).alias("l")).distinct()
    met = small.join(large, ["w", "l"]).where("za <= zb")
    met = met.where(compatible(F.col("ta"), F.col("tb"))).select("na", "nb").distinct()
    pairs = met.join(d.toDF("ia", "na"), "na").join(d.toDF("ib", "nb"), "nb").where("ia <> ib")
    out = pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
    return out.join(apart.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")), ["id_a", "id_b"], "left_anti") if apart is not None else out


def rank_duplicates(pairs: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """(id_a, id_b, one count a dimension) of what both persons of a pair are linked to; ``links``: (person_id, value)."""
    for dim, v in links.items():
        v = v.select("person_id", "value").where("person_id is not null and value is not null").distinct()
        a, b = v.toDF("id_a", "value"), v.toDF("id_b", "value")
        n = pairs.select("id_a", "id_b").join(a, "id_a").join(b, ["id_b", "value"]).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias(dim))
        pairs = pairs.join(n, ["id_a", "id_b"], "left").withColumn(dim, F.coalesce(dim, F.lit(0)))
    return pairs


def intruders(sigs: DataFrame, person: str, name: str) -> DataFrame:
    """(person, name) of names incompatible with the most frequent name of their person."""
    top = consensus(sigs, [person], name).select(person, F.col(name).alias("__top"))
    return sigs.select(person, name).where(f"{person} is not null and {name} is not null").distinct().join(top, person).where(~names_compatible(F.col(name), F.col("__top"))).select(person, name)


def repeated_person(sigs: DataFrame, record: str, person: str) -> DataFrame:
    """Persons that sign one record twice or more: (record, person, n)."""
    return sigs.where(F.col(person).isNotNull()).groupBy(record, person).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def repeated_accounts(sigs: DataFrame, account: str) -> DataFrame:
    """(person_id, accounts) of persons whose signatures carry two or more accounts."""
    g = sigs.where(F.col("person_id").isNotNull() & F.col(account).isNotNull()).groupBy("person_id").agg(F.array_sort(F.collect_set(account)).alias("accounts"))
    return g.where(F.size("accounts") >= 2)


def orphans(sigs: DataFrame, limit: int | None = None) -> DataFrame:
    """Signatures inside the perimeter without a person, the newest first."""
    q = sigs.where("in_perimeter and person_id is null and raw_author_name is not null and trim(raw_author_name) <> ''").orderBy(F.desc_nulls_last("created_at"), "id")
    return q if limit is None else q.limit(limit)


def compatible_pairs(names: DataFrame) -> DataFrame:
    """(a, b), a < b, of names (id, last, first) that share a part and are compatible, each pair once.

    Under each of its parts the name with fewer words brings one more word, the other brings all of its words and their
    initials; only what fits in that word too meets. A pair with two common parts or words counts under one
    of them, so no pair is shuffled.
    """
    n = names.select("id", "last", "first", name_tokens("last", "first").alias("t")).where("size(t) > 0")
    n = n.withColumn("k", F.explode(F.array_distinct(F.array("last", "first")))).where("k <> ''")
    more = F.array_except("t", name_tokens("k"))
    longest = F.array_max(F.transform(F.when(F.size(more) > 0, more).otherwise(F.col("t")), lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    initial = lambda w: F.concat(F.lit("*"), F.substring(w, 1, 1))
    keys = F.when(F.length("w") > 1, F.array(F.col("w"), F.substring("w", 1, 1))).otherwise(F.array(initial(F.col("w"))))
    other = F.when(F.col("k") == F.col("last"), F.col("first")).otherwise(F.col("last"))
    text = F.array_join("t", " ")
    small = n.withColumn("w", longest).select(F.col("id").alias("i"), text.alias("x"), "w", "k", other.alias("o"), F.explode(keys).alias("m"))
    small = small.withColumn("key", F.xxhash64("k", "m"))
    words = F.array_distinct(F.concat("t", F.transform("t", initial)))
    big = n.select(F.col("id").alias("j"), text.alias("y"), F.col("k").alias("p"), other.alias("q"), F.explode(F.transform(words, lambda w: F.xxhash64(F.col("k"), w))).alias("key"))
    x, y = F.split("x", " "), F.split("y", " ")
    first_met = ~((F.col("m") != F.col("w")) & (F.length("w") > 1) & F.array_contains(y, F.col("w")))
    least = (F.col("k") == F.col("p")) & ~((F.col("o") == F.col("q")) & (F.col("o") != "") & (F.col("o") < F.col("k")))
    order = (F.size(x) < F.size(y)) | ((F.size(x) == F.size(y)) & (F.col("i") < F.col("j")))
    met = small.join(big, "key").where((F.col("i") != F.col("j")) & order & least & first_met & compatible(x, y))
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def one_edit_pairs(names: DataFrame) -> DataFrame:
    """F16: (a, b), a < b, of names (id, last, first) that share a part and whose given names are within one edit, each pair once.

    Three kinds that exclude each other: equal given names, which are classes; one family name beside two given
    names, which meet as distinct names on their forms with one letter less; and a given name that is the other's
    family name, which must then be within one edit of its own given name. No pair is shuffled.
    """
    n = names.select("id", "last", "first")
    part = F.when(F.col("first") != "", F.struct(F.lit("").alias("last"), "first")).when(F.col("last") != "", F.struct("last", "first"))
    same = class_pairs(n.select(part.alias("k"), "id").where("k is not null"), "k", "id").select("a", "b")
    forms = n.where("last <> ''").select("last", "first").distinct().withColumn("form", F.explode(one_short(F.col("first"))))
    met = forms.join(forms.withColumnRenamed("first", "next"), ["last", "form"]).where(F.col("first") < F.col("next")).select("last", "first", "next").distinct()
    met = met.where(within_one_edit(F.col("first"), F.col("next")))
    near = met.join(n.withColumnRenamed("id", "i"), ["last", "first"]).join(n.select(F.col("id").alias("j"), "last", F.col("first").alias("next")), ["last", "next"])
    own = n.where((F.col("last") != "") & (F.col("first") != F.col("last")) & within_one_edit(F.col("first"), F.col("last"))).toDF("i", "l", "f")
    crossed = own.join(n.withColumnRenamed("id", "j"), F.col("l") == F.col("first")).where(F.col("l") != F.col("last"))
    crossed = crossed.where((F.col("last") != F.col("f")) | (F.col("last") == "") | (F.col("i") < F.col("j")))
    pairs = near.select("i", "j").unionByName(crossed.select("i", "j")).where("i <> j")
    return same.unionByName(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
