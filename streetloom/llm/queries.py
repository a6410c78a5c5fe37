"""Queries of the training-data operators: pN_found and companions, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streetloom.llm import abuse, copies, encodings, leaks, linkage, lookalikes, names, packing, sites, vocabmap
from streetloom.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: linkage.p1_found(t(s, d, "patient_addresses"), t(s, d, "vocab_entries")),
        "p1_locations": lambda s, d: linkage.p1_locations(t(s, d, "patient_addresses"), t(s, d, "vocab_entries")),
        "p2_found": lambda s, d: copies.p2_found(t(s, d, "addresses")),
        "p2_ledger": lambda s, d: copies.p2_ledger(t(s, d, "addresses")),
        "p3_found": lambda s, d: lookalikes.p3_found(t(s, d, "addresses")),
        "p3_canonical": lambda s, d: lookalikes.look_alikes(t(s, d, "addresses")),
        "p4_found": lambda s, d: sites.p4_found(t(s, d, "clinic_sites"), t(s, d, "payer_sites"), t(s, d, "vocab_entries")),
        "p4_matches": lambda s, d: sites.p4_matches(t(s, d, "clinic_sites"), t(s, d, "payer_sites"), t(s, d, "vocab_entries")),
        "p5_found": lambda s, d: encodings.p5_found(t(s, d, "addresses")),
        "p5_restored": lambda s, d: encodings.wrong_encodings(t(s, d, "addresses")),
        "p7_found": lambda s, d: vocabmap.p7_found(t(s, d, "addresses"), t(s, d, "vocab_entries")),
        "p7_unmatched": lambda s, d: vocabmap.p7_unmatched(t(s, d, "addresses"), t(s, d, "vocab_entries")),
        "p7_steps": lambda s, d: vocabmap.p7_steps(t(s, d, "addresses"), t(s, d, "vocab_entries")),
        "p8_containers": lambda s, d: packing.p8_containers(t(s, d, "documents")),
        "p8_fill": lambda s, d: packing.p8_fill(t(s, d, "documents")),
        "p9_found": lambda s, d: leaks.p9_found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_spans": lambda s, d: leaks.p9_spans(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_phrases": lambda s, d: leaks.p9_phrases(t(s, d, "documents"), t(s, d, "eval_items")),
        "p10_found": lambda s, d: abuse.p10_found(t(s, d, "documents"), t(s, d, "doc_reviews")),
        "p10_rates": lambda s, d: abuse.p10_rates(t(s, d, "documents"), t(s, d, "doc_reviews")),
        "p6_found": lambda s, d: names.p6_found(t(s, d, "firm_mentions")),
        "p6_entities": lambda s, d: names.p6_entities(t(s, d, "firm_mentions")),
    }


_KEYED = """rows_ AS (SELECT addr_id, """ + ", ".join(f"regexp_replace(upper(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS c{i}" for i, c in enumerate(copies.FIXED)) + """,
  list_sort([""" + ", ".join(f"regexp_replace(upper(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')" for c in copies.SWAPPABLE) + """]) AS s FROM addresses),
grp AS (SELECT min(addr_id) AS first_addr_id, count(*) AS n_copies, list(addr_id) AS ids FROM rows_ GROUP BY ALL)"""


def _phrases(table: str, id_col: str) -> str:
    """Every run of four words of a table's texts, with its place."""
    return (f"SELECT {id_col}, i, list_slice(w, i, i + 3) AS phrase FROM (SELECT {id_col}, w, unnest(range(1, len(w) - 2)) AS i FROM "
            f"(SELECT {id_col}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table}))")


def oracle_sql() -> dict[str, str]:
    cols = ", ".join(f"c{i}" for i in range(len(copies.FIXED)))
    keyed = _KEYED.replace("GROUP BY ALL", f"GROUP BY {cols}, s")
    return {
        "p9_phrases": f"WITH known AS (SELECT DISTINCT phrase FROM ({_phrases('eval_items', 'item_id')})) SELECT doc_id, count(*) AS n_hits, count(DISTINCT phrase) AS n_phrases FROM ({_phrases('documents', 'doc_id')}) SEMI JOIN known USING (phrase) GROUP BY doc_id",
        "p2_ledger": f"WITH {keyed} SELECT first_addr_id, n_copies FROM grp",
        "p2_found": f"WITH {keyed} SELECT first_addr_id, addr_id FROM (SELECT first_addr_id, unnest(ids) AS addr_id FROM grp) WHERE addr_id <> first_addr_id",
    }
