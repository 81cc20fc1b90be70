"""Queries of the llm operators with the SQL that checks them."""

from __future__ import annotations

from stratalog.llm import alike, docpairs, mix, neighbours, residue, split, tokenize

SQL = {
    "p1_found": r"""select distinct 'node' as tbl, id as item_id from node
        where length(body) > 4000 or len(regexp_extract_all(body, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 400
        union select 'doc_chunk', chunk_id from doc_chunk
        where length(body) > 4000 or len(regexp_extract_all(body, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) > 400""",
}


def queries() -> dict:
    return {
        "p1_found": split.p1_found,
        "p1_pieces": split.p1_pieces,
        "p3_found": neighbours.p3_found,
        "p3_similar": neighbours.p3_similar,
        "p4_found": docpairs.p4_found,
        "p4_pairs": docpairs.p4_pairs,
        "p4_refused": docpairs.p4_refused,
        "p7_found": alike.p7_found,
        "p7_groups": alike.p7_groups,
        "p8_ids": tokenize.p8_ids,
        "p8_lengths": tokenize.p8_lengths,
        "p9_mix": mix.p9_mix,
        "p9_shares": mix.p9_shares,
        "p10_found": residue.p10_found,
        "p10_clean": residue.p10_clean,
        "p10_reasons": residue.p10_reasons,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
