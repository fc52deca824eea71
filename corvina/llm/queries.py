"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from corvina.llm import addresses, canonical, components, encoding, linkage, mixing, names, survivor, tokenize

QUERIES = {
    "p1_found": components.p1_found,
    "p1_groups": components.p1_groups,
    "p3_found": canonical.p3_found,
    "p3_unmatched": canonical.p3_unmatched,
    "p4_found": linkage.p4_found,
    "p4_pairs": linkage.p4_pairs,
    "p4_works": linkage.p4_works,
    "p5_found": names.p5_found,
    "p5_classes": names.p5_classes,
    "p6_found": survivor.p6_found,
    "p6_survivors": survivor.p6_survivors,
    "p6_values": survivor.p6_values,
    "p7_found": addresses.p7_found,
    "p7_places": addresses.p7_places,
    "p8_ids": tokenize.p8_ids,
    "p8_decoded": tokenize.p8_decoded,
    "p9_draws": mixing.p9_draws,
    "p9_shares": mixing.p9_shares,
    "p10_found": encoding.p10_found,
    "p10_restored": encoding.p10_restored,
}

#: Most operators are iterative, statistical or run a tokenizer; they are tested against brute force instead.
SQL: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
