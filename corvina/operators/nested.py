"""Problem 2: deeply nested records to related flat tables.

Each payload is parsed once, in a stream of Arrow batches, into path-value-ordinal triples: every
node below a repeated ancestor gives one row with the ancestor's path (``grp``), the positions on
the way to it (``ords``), the path relative to the ancestor (``rel``) and its value. A group of
triples is then pivoted into one table whose key is (record, ordinals), so the parent's key is the
key without its last position.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.session import Cut, spread, table

TITLE = "static_data.summary.titles.title"
NAME = "static_data.summary.names.name"
ADDRESS = "static_data.fullrecord_metadata.addresses.address_name"
ORGANIZATION = ADDRESS + ".address_spec.organizations.organization"
LOCATION = "locations"
LOCATION_SOURCE = "locations.source"
#: Paths whose value counts as a list even where a payload holds a single item.
REPEATED = (TITLE, NAME, ADDRESS, ORGANIZATION, LOCATION, LOCATION_SOURCE)
CHILDREN = {
    TITLE: "title", NAME: "name", ADDRESS: "address", ORGANIZATION: "organization",
    LOCATION: "location", LOCATION_SOURCE: "location_source",
}

TRIPLES = "rid bigint, grp string, ords array<int>, rel string, kind string, value string"
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}


def read_payload(text: str | None):
    """The JSON object of a payload, or None if it is null or unreadable.

    A text that holds JSON again, or a list of one item, is unwrapped until something else stands there; each
    step leaves a shorter text, so it ends.
    """
    if text is None:
        return None
    value: object = text
    while True:
        if isinstance(value, str):
            try:
                value = json.loads(value.lstrip("﻿"))
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, list) and len(value) == 1:
            value = value[0]
        else:
            return value if isinstance(value, dict) else None


def walk(root: dict, repeated: frozenset[str]) -> Iterator[tuple[str, list[int], str, str, str | None]]:
    """(group, ordinals, relative path, kind, value) of each node below a repeated ancestor, in document order."""
    stack: list[tuple[object, str, str, list[int]]] = [(root, "", "", [])]
    while stack:
        node, path, grp, ords = stack.pop()
        if path and path != grp and (isinstance(node, list) or (path in repeated and node is not None)):
            items = node if isinstance(node, list) else [node]
            for k in range(len(items), 0, -1):
                stack.append((items[k - 1], path, path, [*ords, k]))
            continue
        if grp:
            kind = "null" if node is None else _KINDS[type(node)]
            value = None if node is None or isinstance(node, (dict, list)) else node if isinstance(node, str) else json.dumps(node)
            yield grp, ords, path[len(grp) + 1 :], kind, value
        if isinstance(node, dict):
            for key in reversed(node):
                stack.append((node[key], f"{path}.{key}" if path else key, grp, ords))
        elif isinstance(node, list):  # a list directly in a list: positions go on within the same group
            for k in range(len(node), 0, -1):
                stack.append((node[k - 1], path, grp, [*ords, k]))


def triples(
    df: DataFrame,
    rid: str,
    payload: str,
    repeated: Iterable[str] = REPEATED,
    groups: Iterable[str] | None = None,
    rels: Iterable[str] | None = None,
) -> DataFrame:
    """Path-value-ordinal triples (columns ``TRIPLES``) of a table of JSON texts.

    Null, empty and unreadable payloads give no rows. ``groups`` and ``rels`` keep only the triples a
    caller will pivot, before they leave the Python worker.
    """
    rep, want = frozenset(repeated), None if groups is None else frozenset(groups)
    keep = None if rels is None else frozenset(rels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["rid", "grp", "ords", "rel", "kind", "value"]
        for pdf in batches:
            rows: list[tuple] = []
            for i, text in zip(pdf["rid"], pdf["payload"]):
                root = read_payload(text)
                if root is None:
                    continue
                for g, ords, rel, kind, value in walk(root, rep):
                    if (want is None or g in want) and (keep is None or rel in keep):
                        rows.append((i, g, ords, rel, kind, value))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    src = df.select(F.col(rid).cast("bigint").alias("rid"), F.col(payload).alias("payload")).where("rid is not null and payload is not null")
    return spread(src).mapInPandas(run, TRIPLES)


def pivot_group(t: DataFrame, grp: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one group: record_id, parent_path (positions of the ancestors), pos, kind and ``columns``.

    ``columns`` maps output names to relative paths; a path that an item lacks is null. The aggregation
    combines on the map side and the triples of a record come from one task, so little is shuffled.
    """
    aggs = [F.max(F.when(F.col("rel") == rel, F.col("value"))).alias(name) for name, rel in columns.items()]
    return (
        t.where(F.col("grp") == grp)
        .groupBy(F.col("rid").alias("record_id"), "ords")
        .agg(F.max(F.when(F.col("rel") == "", F.col("kind"))).alias("kind"), *aggs)
        .select(
            "record_id",
            F.slice("ords", F.lit(1), F.size("ords") - 1).alias("parent_path"),
            F.element_at("ords", -1).alias("pos"),
            "kind",
            *columns,
        )
    )


def children(t: DataFrame) -> DataFrame:
    """(staging_id, child, parent_pos, child_pos) of every object item, and the name-address links."""
    child = F.create_map(*[F.lit(x) for kv in CHILDREN.items() for x in kv])[F.col("grp")]
    items = t.where((F.col("rel") == "") & (F.col("kind") == "object") & F.col("grp").isin(*CHILDREN)).select(
        F.col("rid").alias("staging_id"),
        child.alias("child"),
        F.when(F.size("ords") > 1, F.element_at("ords", F.size("ords") - 1)).otherwise(F.lit(0)).cast("int").alias("parent_pos"),
        F.element_at("ords", -1).alias("child_pos"),
    )
    no = lambda grp, rel: (
        t.where((F.col("grp") == grp) & F.col("rel").isin(*rel) & F.col("value").isNotNull())
        .select(
            "rid",
            F.col("ords")[0].alias("pos"),
            F.explode(F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(r"(\d+)")), lambda x: x.try_cast("bigint")))).alias("no"),
        )
        .where("no is not null")
    )
    names, addresses = no(NAME, ["addr_no"]), no(ADDRESS, ["address_spec.addr_no"])
    links = (
        names.withColumnRenamed("pos", "np")
        .join(addresses.withColumnRenamed("pos", "ap"), ["rid", "no"])
        .select(F.col("rid").alias("staging_id"), F.lit("name_address").alias("child"), F.col("np").cast("int").alias("parent_pos"), F.col("ap").cast("int").alias("child_pos"))
        .distinct()
    )
    return items.unionByName(links)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    st = table(spark, base, "staging").select("id", "raw_data")
    # Written once, so that the payloads are parsed once for the items and both sides of the links.
    return children(Cut(spark)(triples(st, "id", "raw_data", groups=CHILDREN, rels=("", "addr_no", "address_spec.addr_no"))))


def _flat(grp: str, columns: dict[str, str]):
    def query(spark: SparkSession, base: str) -> DataFrame:
        st = table(spark, base, "staging").select("id", "raw_data")
        t = triples(st, "id", "raw_data", groups=[grp], rels=["", *columns.values()])
        return pivot_group(t, grp, columns).where("kind = 'object'").drop("kind")

    return query


TABLES = {
    "titles": (TITLE, {"title_type": "type", "content": "content"}),
    "names": (NAME, {"seq_no": "seq_no", "role": "role", "display_name": "display_name", "full_name": "full_name", "addr_no": "addr_no", "daisng_id": "daisng_id", "reprint": "reprint"}),
    "addresses": (ADDRESS, {"addr_no": "address_spec.addr_no", "full_address": "address_spec.full_address", "country": "address_spec.country"}),
    "organizations": (ORGANIZATION, {"content": "content", "pref": "pref", "ror_id": "ror_id"}),
    "locations": (LOCATION, {"location_id": "id", "landing_page_url": "landing_page_url", "is_oa": "is_oa", "pdf_url": "pdf_url"}),
    "location_sources": (LOCATION_SOURCE, {"source_id": "id", "display_name": "display_name"}),
}
QUERIES = {"p2_found": p2_found, **{f"p2_{n}": _flat(*x) for n, x in TABLES.items()}}

# The same in SQL: payloads are unwrapped by recursion, and a path's items are listed with their positions.
_READ = """RECURSIVE u(id, r) AS (SELECT id, ltrim(raw_data, chr(65279)) FROM staging WHERE raw_data IS NOT NULL UNION ALL SELECT id, CASE json_type(r) WHEN 'VARCHAR' THEN ltrim(json_extract_string(r, '$'), chr(65279)) ELSE json_extract(r, '$[0]')::varchar END FROM u WHERE json_valid(r) AND (json_type(r) = 'VARCHAR' OR (json_type(r) = 'ARRAY' AND json_array_length(r) = 1))),
p AS (SELECT id, r::json AS r FROM u WHERE json_valid(r) AND json_type(r) = 'OBJECT')"""


def _items(name: str, source: str, node: str, path: str, keep: str) -> str:
    """A CTE of the object items at ``path`` below ``node``, with position ``pos``; a single item counts as a list."""
    many = f"CASE json_type({node}, '{path}') WHEN 'ARRAY' THEN from_json(json_extract({node}, '{path}'), '[\"JSON\"]') WHEN 'NULL' THEN [] ELSE CASE WHEN json_extract({node}, '{path}') IS NULL THEN [] ELSE [json_extract({node}, '{path}')] END END"
    return f"{name} AS (SELECT * FROM (SELECT {keep}, unnest({many}) AS x, generate_subscripts({many}, 1)::int AS pos FROM {source}) WHERE json_type(x) = 'OBJECT')"


def _field(rel: str) -> str:
    return f"CASE WHEN json_type(x, '$.{rel}') IN ('OBJECT', 'ARRAY') THEN NULL ELSE x ->> '$.{rel}' END"


_LISTS = {
    "titles": [_items("titles", "p", "r", f"$.{TITLE}", "id")],
    "names": [_items("names", "p", "r", f"$.{NAME}", "id")],
    "addresses": [_items("addr", "p", "r", f"$.{ADDRESS}", "id")],
    "organizations": [_items("addr", "p", "r", f"$.{ADDRESS}", "id"), _items("orgs", "addr", "y", "$.address_spec.organizations.organization", "id, up").replace("FROM addr)", "FROM (SELECT id, x AS y, pos AS up FROM addr))")],
    "locations": [_items("locs", "p", "r", f"$.{LOCATION}", "id")],
    "location_sources": [_items("locs", "p", "r", f"$.{LOCATION}", "id"), _items("srcs", "locs", "y", "$.source", "id, up").replace("FROM locs)", "FROM (SELECT id, x AS y, pos AS up FROM locs))")],
}
_LAST = {"titles": "titles", "names": "names", "addresses": "addr", "organizations": "orgs", "locations": "locs", "location_sources": "srcs"}
SQL = {
    f"p2_{n}": f"WITH {_READ}, {', '.join(_LISTS[n])} SELECT id AS record_id, {'[up]' if n in ('organizations', 'location_sources') else '[]::int[]'} AS parent_path, pos, {', '.join(f'{_field(rel)} AS {c}' for c, rel in cols.items())} FROM {_LAST[n]}"
    for n, (_, cols) in TABLES.items()
}
_NUMBERS = "list_distinct(list_transform(regexp_extract_all(v, '\\d+'), lambda d: try_cast(d AS bigint)))"
SQL["p2_found"] = f"""WITH {_READ}, {_LISTS['titles'][0]}, {_LISTS['names'][0]}, {', '.join(_LISTS['organizations'])}, {', '.join(_LISTS['location_sources'])},
nn AS (SELECT DISTINCT id, pos, unnest({_NUMBERS.replace('v,', _field('addr_no') + ',')}) AS no FROM names), an AS (SELECT DISTINCT id, pos, unnest({_NUMBERS.replace('v,', _field('address_spec.addr_no') + ',')}) AS no FROM addr)
SELECT id AS staging_id, 'title' AS child, 0 AS parent_pos, pos AS child_pos FROM titles UNION ALL SELECT id, 'name', 0, pos FROM names UNION ALL SELECT id, 'address', 0, pos FROM addr UNION ALL SELECT id, 'organization', up, pos FROM orgs UNION ALL SELECT id, 'location', 0, pos FROM locs UNION ALL SELECT id, 'location_source', up, pos FROM srcs
UNION ALL SELECT DISTINCT nn.id, 'name_address', nn.pos, an.pos FROM nn JOIN an ON nn.id = an.id AND nn.no = an.no WHERE nn.no IS NOT NULL"""
