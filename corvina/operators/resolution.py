"""Publication resolution: keys, partitions, claims, survivors, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import vocabularies as V
from corvina.functions.domain import ARTICLE_SUBTYPES, best_oa
from corvina.functions.identifiers import arxiv_id, clean_doi, nnt, pmid
from corvina.functions.vocabularies import ARCHIVES
from corvina.operators import joins as J
from corvina.operators.aggregates import first_by_priority, rank_of
from corvina.operators.graph import class_pairs, components, lookup

# Sources in the order of trust, and the length from which a title is a key.
PRIORITY = ("theses", "crossref", "datacite", "hal", "openalex", "scanr", "wos")
TITLE_KEY = 30


def confirmation_keys(sp: DataFrame) -> DataFrame:
    """(id, type, value) of every key that confirms a record: doi, nnt, pmid, each hal_id, and title with year if long enough."""
    m = F.from_json("external_ids", "map<string,string>")
    hal = F.regexp_extract_all(F.lower(m["hal_id"]), F.lit(r"([a-z][a-z0-9]*-\d{8,})"), 1)
    kv = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    block = F.when((F.length("title_normalized") > TITLE_KEY) & F.col("pub_year").isNotNull(), F.concat_ws("|", "title_normalized", F.col("pub_year").cast("string")))
    keys = F.concat(
        F.array(kv("doi", clean_doi(F.col("doi"))), kv("nnt", nnt(m["nnt"])), kv("pmid", pmid(m["pmid"])), kv("metadata_block", block)),
        F.transform(F.coalesce(hal, F.array().cast("array<string>")), lambda x: kv("hal_id", x)),
    )
    return sp.select("id", F.explode(F.filter(keys, lambda k: k["value"].isNotNull())).alias("k")).select("id", "k.type", "k.value").distinct()


def cannot_link(labels: DataFrame, dois: DataFrame) -> DataFrame:
    """(id, label, part): a component with two or more DOIs is one part a DOI; its records without DOI are residual (null)."""
    d = labels.join(dois, "id", "left")
    n = d.groupBy("label").agg(F.count_distinct("doi").alias("n"))
    part = F.when(F.col("n") <= 1, F.lit("")).otherwise(F.col("doi"))
    return lookup(d, n, "label").select("id", "label", part.alias("part"))


def publication_keys(sp: DataFrame) -> DataFrame:
    """(publication_id, type, value): the deposits, arXiv, PubMed and thesis ids that a publication's records carry."""
    m = F.from_json("external_ids", "map<string,string>")
    hal = F.regexp_extract_all(F.lower(m["hal_id"]), F.lit(r"([a-z][a-z0-9]*-\d{8,})"), 1)
    kv = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    keys = F.concat(
        F.array(kv("arxiv_id", arxiv_id(m["arxiv_id"])), kv("pmid", pmid(m["pmid"])), kv("nnt", nnt(m["nnt"]))),
        F.transform(F.coalesce(hal, F.array().cast("array<string>")), lambda x: kv("hal_id", x)),
    )
    return sp.where("publication_id is not null").select("publication_id", F.explode(F.filter(keys, lambda k: k["value"].isNotNull())).alias("k")).select("publication_id", "k.type", "k.value").distinct()


def claims(members: DataFrame, carriers: DataFrame | None = None) -> DataFrame:
    """(label, part, anchor, action, first): the publication that each part keeps, or that a new one is made.

    A part prefers the publication that carries its DOI (the smallest), else one outside the records that
    does (``carriers``: doi, publication_id), else that of its smallest placed record. A publication goes to
    one part: to a carried DOI first, then to the part with the smallest record; the others get a new one.
    A part without any publication gets a new one only if a record lies inside the perimeter and one has
    title and year; else it has no row and its records stay unplaced.
    ``members``: id, label, part (null: residual), publication_id, publication_doi, doi, in_perimeter, title_normalized, pub_year.
    """
    m = members.where("part is not null")
    usable = F.coalesce((F.col("title_normalized") != "") & (F.col("pub_year") > 0), F.lit(False))
    placed = F.when(F.col("publication_id").isNotNull(), F.col("id"))
    parts = m.groupBy("label", "part").agg(
        F.min("id").alias("first"), F.max("doi").alias("doi"), F.min_by("publication_id", placed).alias("weak"),
        F.bool_or(usable).alias("usable"), F.bool_or(F.coalesce("in_perimeter", F.lit(False))).alias("inside"),
    )
    own = m.where("publication_id is not null and publication_doi is not null").groupBy("label", "part", F.col("publication_doi").alias("doi")).agg(F.min("publication_id").alias("carrier"))
    p = parts.join(own, ["label", "part", "doi"], "left")
    outside = carriers.groupBy("doi").agg(F.min("publication_id").alias("outside")) if carriers is not None else None
    p = p.join(outside, "doi", "left") if outside is not None else p.withColumn("outside", F.lit(None).cast("bigint"))
    p = p.withColumn("strong", F.coalesce("carrier", "outside").isNotNull()).withColumn("wanted", F.coalesce("carrier", "outside", "weak"))
    p = p.where(F.col("wanted").isNotNull() | (F.col("inside") & F.col("usable")))
    won = p.where("wanted is not null").groupBy("wanted").agg(F.min(F.struct((~F.col("strong")).alias("w"), "first")).alias("b")).select("wanted", F.col("b.first").alias("winner"))
    p = p.join(won, "wanted", "left").withColumn("anchor", F.when(F.col("winner") == F.col("first"), F.col("wanted")))
    return p.select("label", "part", "anchor", F.when(F.col("anchor").isNull(), "create").otherwise("keep").alias("action"), "first")


def dissolved(members: DataFrame, kept: DataFrame) -> DataFrame:
    """E5: (publication_id, successor) of publications that no part keeps and no unassigned record holds; the successor
    is what the part of their smallest record keeps, if that is an existing one."""
    m = members.where("publication_id is not null").select("id", "label", "part", "publication_id")
    k = kept.select("label", "part", "anchor").withColumn("assigned", F.lit(True))
    m = m.join(k, ["label", "part"], "left")
    held = m.where("assigned is null").select("publication_id").distinct()
    alive = kept.where("anchor is not null").select(F.col("anchor").alias("publication_id"))
    gone = m.join(alive, "publication_id", "left_anti").join(held, "publication_id", "left_anti")
    out = gone.groupBy("publication_id").agg(F.min_by("anchor", "id").alias("successor"))
    return out.where("successor is not null and successor <> publication_id")


def dirty_universe(sp: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of dirty records and of all records one shared key away."""
    dirty = sp.where("keys_dirty").select("id")
    near = keys.join(keys.join(dirty, "id", "left_semi").select("type", "value").distinct(), ["type", "value"], "left_semi").select("id")
    return dirty.unionByName(near).distinct()


def resolve(spark: SparkSession, sp: DataFrame) -> DataFrame:
    """E1-E3 together: (id, label, part) of every record."""
    keys = confirmation_keys(sp)
    labels = components(spark, sp.select("id"), keys.select("id", F.concat_ws(":", "type", "value").alias("token")))
    return cannot_link(labels, sp.select("id", clean_doi(F.col("doi")).alias("doi")))


def united_lists(df: DataFrame, key: str, column: str, *order: Column) -> DataFrame:
    """(key, column): union of a list column over each key; what differs in case only counts once, as first met by ``order``.

    Items are aggregated before they are put in order, so a large key is never held whole.
    """
    e = df.where(F.col(key).isNotNull()).select(key, F.struct(*order).alias("o"), F.posexplode(column).alias("p", "x")).where("x is not null")
    first = e.groupBy(key, F.lower(F.col("x").cast("string")).alias("l")).agg(F.min(F.struct("o", "p", "x")).alias("m"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]).alias(column))


def merged_maps(df: DataFrame, key: str, column: str, *order: Column) -> DataFrame:
    """(key, column): shallow merge of a JSON object column over each key, as map<string,string>; the first by ``order`` gives an entry."""
    e = df.where(F.col(key).isNotNull()).select(key, F.struct(*order).alias("o"), F.explode(F.from_json(column, "map<string,string>")).alias("k", "v")).where("v is not null")
    first = e.groupBy(key, "k").agg(F.min(F.struct("o", "v")).alias("m"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "m.v")))).alias(column))


def by_source(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): a map from source to its own value (topics keep each source's form); of one source the smallest id counts."""
    d = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key, "source").agg(F.min_by(column, "id").alias("v"))
    return d.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "v")))).alias(column))


FIELDS = ("title", "title_normalized", "doi", "pub_year", "journal_id", "container_title", "language", "abstract")
#: Columns that a record may have beside ``FIELDS``: lists to unite, JSON objects to merge, values kept by source.
LISTS, MAPS, PER_SOURCE = ("keywords", "countries"), ("biblio", "meta"), ("topics",)


def survivors(sp: DataFrame, key: str = "publication_id", secondary: Column | None = None, checked: DataFrame | None = None) -> DataFrame:
    """One record for each ``key``.

    Scalars: the first non-null value by (secondary last, source priority, id). The most open known status,
    ``unknown`` if none is; ``article`` gives way to a subtype that any record has, and no type is ``other``.
    Lists are united, JSON objects merged, topics kept by source, where ``sp`` has such columns.
    ``checked``: key, oa_status, the verdict of an outside check. It stands, unless it is closed or unknown
    while an archive holds the file (a ``green`` record of one).
    """
    sec = F.coalesce(secondary, F.lit(False)) if secondary is not None else F.lit(False)
    order = (sec, rank_of(F.col("source"), PRIORITY), F.col("id"))
    status = F.lower(F.trim("oa_status"))
    kind = first_by_priority(F.col("doc_type"), *order)
    subtype = first_by_priority(F.when(F.col("doc_type").isin(*ARTICLE_SUBTYPES), F.col("doc_type")), *order)
    out = sp.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[first_by_priority(F.col(f), *order).alias(f) for f in FIELDS if f in sp.columns], kind.alias("__k"), subtype.alias("__s"), F.coalesce(best_oa(status), F.lit("unknown")).alias("oa_status"),
        F.bool_or(F.coalesce("is_retracted", F.lit(False))).alias("is_retracted"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.bool_or(F.coalesce(F.col("source").isin(*ARCHIVES) & (status == "green"), F.lit(False))).alias("__deposit"),
    )
    out = out.withColumn("doc_type", F.coalesce(F.when((F.col("__k") == "article") & F.col("__s").isNotNull(), F.col("__s")).otherwise(F.col("__k")), F.lit("other")))
    if checked is not None:
        out = out.join(checked.select(key, F.col("oa_status").alias("__v")), key, "left")
        reopened = F.col("__v").isin("closed", "unknown") & F.col("__deposit")
        out = out.withColumn("oa_status", F.when(F.col("__v").isNull() | reopened, F.col("oa_status")).otherwise(F.col("__v"))).drop("__v")
    for names, gather in ((LISTS, united_lists), (MAPS, merged_maps)):
        for c in (c for c in names if c in sp.columns):
            out = out.join(gather(sp, key, c, *order), key, "left")
    for c in (c for c in PER_SOURCE if c in sp.columns):
        out = out.join(by_source(sp, key, c), key, "left")
    return out.drop("__k", "__s", "__deposit")


def declared_relations(records: DataFrame) -> DataFrame:
    """(source_id, target_doi, type) declared by records of datacite and crossref, in the canonical vocabulary.

    ``records``: publication_id, source, meta (JSON): datacite lists ``related_identifiers`` of (doi,
    relation_type), crossref has ``relation``, a list of (id, id-type) for each name. Names out of scope
    (versions, citations, reviews), targets that aren't DOIs and unreadable meta give nothing.
    """
    d = records.where("publication_id is not null and source = 'datacite'").select("publication_id", F.explode(F.from_json(F.get_json_object("meta", "$.related_identifiers"), "array<struct<doi:string,relation_type:string>>")).alias("r"))
    d = d.select("publication_id", F.col("r.doi").alias("doi"), V.lookup(V.DATACITE_RELATIONS, F.col("r.relation_type")).alias("type"))
    c = records.where("publication_id is not null and source = 'crossref'").select("publication_id", F.explode(F.from_json(F.get_json_object("meta", "$.relation"), "map<string,array<struct<id:string,`id-type`:string>>>")).alias("k", "v"))
    c = c.select("publication_id", "k", F.explode("v").alias("r")).where(F.col("r.id-type") == "doi").select("publication_id", F.col("r.id").alias("doi"), V.lookup(V.CROSSREF_RELATIONS, F.col("k")).alias("type"))
    out = d.unionByName(c).select(F.col("publication_id").alias("source_id"), clean_doi(F.col("doi")).alias("target_doi"), "type")
    return out.where("target_doi is not null and type is not null").distinct()


def shared_key_relations(pubs: DataFrame, keys: DataFrame) -> DataFrame:
    """(source_id, target_id, type) of publications with different DOIs that share a key.

    A preprint, erratum or dataset beside anything else, in that order, is the source of its relation; a
    chapter is part of a book; all else is related, from the smaller id. Reviews of peers have none.
    ``pubs``: publication_id, doc_type, doi; ``keys``: publication_id, type, value. A key that many
    publications carry is split over tasks.
    """
    k = keys.where("publication_id is not null and value is not null").select(F.xxhash64("type", "value").alias("key"), "publication_id").distinct()
    pairs = class_pairs(k, "key", "publication_id").select("a", "b").distinct()
    t = pubs.where("doi is not null").select("publication_id", F.coalesce("doc_type", F.lit("other")).alias("t"), F.lower("doi").alias("d"))
    j = pairs.join(t.toDF("a", "ta", "da"), "a").join(t.toDF("b", "tb", "db"), "b").where("da <> db and ta <> 'peer_review' and tb <> 'peer_review'")
    kind, from_b = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(True))
    for name, relation in V.DEPENDENT.items():
        a, b = F.col("ta") == name, F.col("tb") == name
        kind, from_b = kind.when(a != b, relation), from_b.when(a != b, b)
    part = ((F.col("ta") == "book") & (F.col("tb") == "book_chapter")) | ((F.col("tb") == "book") & (F.col("ta") == "book_chapter"))
    kind, from_b = kind.when(part, "is_part_of").otherwise("is_related_to"), from_b.when(part, F.col("tb") == "book_chapter").otherwise(False)
    j = j.select("a", "b", kind.alias("type"), from_b.alias("turn"))
    return j.select(F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("source_id"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("target_id"), "type")


#: Years by which a dependent work and its parent may differ.
YEARS = 2


def title_relations(pubs: DataFrame) -> DataFrame:
    """(source_id, target_id, type) of errata whose title ends with that of their parent, and of preprints with the title of the published work.

    The parent's title is longer than ``TITLE_KEY``; an erratum follows it, and a preprint precedes it, by at
    most ``YEARS``. Only a child with exactly one candidate of substance is linked (for errata: no preprint
    or dataset; for preprints: no dataset). Only endings of errata titles are exploded, and met by equality.
    ``pubs``: publication_id, doc_type, title_normalized, pub_year.
    """
    t = pubs.where("title_normalized is not null and pub_year is not null").select("publication_id", "doc_type", F.col("title_normalized").alias("t"), F.col("pub_year").alias("y"))
    parents = t.where(F.length("t") > TITLE_KEY).select(F.col("publication_id").alias("target_id"), F.col("doc_type").alias("kind"), "t", F.col("y").alias("py"))
    ends = J.endings(F.col("t"), TITLE_KEY + 1)
    errata = t.where("doc_type = 'erratum'").select(F.col("publication_id").alias("source_id"), "y", F.explode(ends).alias("t"))
    e = errata.join(parents.where("kind <> 'erratum'"), "t").where(F.col("py").between(F.col("y") - YEARS, F.col("y")) & (F.col("source_id") != F.col("target_id")))
    e = e.withColumn("substance", ~F.col("kind").isin("preprint", "dataset"))
    preprints = t.where((F.col("doc_type") == "preprint") & (F.length("t") > TITLE_KEY)).select(F.col("publication_id").alias("source_id"), "y", "t")
    p = preprints.join(parents.where("kind <> 'preprint'"), "t").where(F.col("py").between(F.col("y"), F.col("y") + YEARS)).withColumn("substance", F.col("kind") != "dataset")
    out = None
    for df, name in ((e, "is_correction_of"), (p, "is_preprint_of")):
        one = df.where("substance").groupBy("source_id").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("target_id")).where("n = 1")
        one = one.select("source_id", "target_id", F.lit(name).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


def rebuild_relations(declared: DataFrame, shared: DataFrame, titles: DataFrame, pubs: DataFrame) -> DataFrame:
    """(source_id, target_id, target_doi, type, signal): the relations table made anew.

    Declared targets are resolved by DOI and stay without id where none is known. One relation for each
    pair, from the first of the three signals that has it; what is only related is dropped where the pair
    has a declared relation in either direction, and relations to itself are dropped.
    ``declared``: source_id, target_doi, type; the others: source_id, target_id, type; ``pubs``: publication_id, doi.
    """
    known = pubs.where("doi is not null").groupBy(F.lower("doi").alias("target_doi")).agg(F.min("publication_id").alias("target_id"))
    d = declared.join(known, "target_doi", "left").select("source_id", "target_id", "target_doi", "type", F.lit(0).alias("signal"))
    ends = d.where("target_id is not null").select(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi")).distinct()
    s = shared.withColumn("lo", F.least("source_id", "target_id")).withColumn("hi", F.greatest("source_id", "target_id"))
    s = s.where("type <> 'is_related_to'").unionByName(s.where("type = 'is_related_to'").join(ends, ["lo", "hi"], "left_anti").select(*s.columns))
    none = F.lit(None).cast("string")
    out = d.unionByName(s.select("source_id", "target_id", none.alias("target_doi"), "type", F.lit(1).alias("signal")))
    out = out.unionByName(titles.select("source_id", "target_id", none.alias("target_doi"), "type", F.lit(2).alias("signal")))
    out = out.where("target_id is null or source_id <> target_id")
    far = F.when(F.col("target_id").isNull(), F.col("target_doi"))
    best = out.withColumn("far", far).groupBy("source_id", "target_id", "far").agg(F.min(F.struct("signal", "type", "target_doi")).alias("m"))
    return best.select("source_id", "target_id", "m.target_doi", "m.type", "m.signal")


def both_ways(relations: DataFrame) -> DataFrame:
    """Q3: each relation from both ends, with its inverse name from the other."""
    back = relations.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), V.lookup(V.INVERSE, F.col("type")).alias("type"))
    return relations.select("source_id", "target_id", "type").unionByName(back)


# Sources of which one publication has one record, and the registrant whose DOIs are versions of each other.
ONE_EACH, VERSIONED = ("hal", "openalex", "wos"), "10.5281/zenodo."


def duplicate_pairs(pubs: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b): publications of the same long title that may be one.

    Not if they have different DOIs (unless both are versions at one registrant), if one is a conference
    paper and the other an article or review, if both have a record of one of ``ONE_EACH``, or if they
    are marked as distinct (``apart``: id_a, id_b). Year and other sources don't matter.
    ``pubs``: publication_id, title_normalized, doi, doc_type, sources. A title that many have is split over tasks.
    """
    p = pubs.where(F.length("title_normalized") > TITLE_KEY)
    pairs = class_pairs(p.select(F.xxhash64("title_normalized").alias("h"), "publication_id"), "h", "publication_id").select("a", "b")
    side = lambda n: p.select(F.col("publication_id").alias(n), F.col("title_normalized").alias(f"t{n}"), F.lower("doi").alias(f"d{n}"), F.col("doc_type").alias(f"k{n}"), F.col("sources").alias(f"s{n}"))
    zenodo = lambda n: F.startswith(F.col(n), F.lit(VERSIONED))
    dois = (F.col("da") != F.col("db")) & ~(zenodo("da") & zenodo("db"))
    paper = lambda x, y: F.col(x).isin("article", "review") & (F.col(y) == "conference_paper")
    one_each = F.array(*map(F.lit, ONE_EACH))
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), one_each)) > 0
    veto = F.coalesce(dois, F.lit(False)) | F.coalesce(paper("ka", "kb") | paper("kb", "ka"), F.lit(False)) | both
    out = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("ta") == F.col("tb")) & ~veto).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return out.join(apart.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")), ["id_a", "id_b"], "left_anti") if apart is not None else out
