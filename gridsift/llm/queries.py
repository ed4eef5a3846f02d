"""The operators as named queries, each over its whole table with production parameters."""

from __future__ import annotations

from gridsift.llm import alignment, embeddings, html, langid, linededup, mixing, packing, prefixtrie, quality, sharding, simhash, substrings, toxicity


def queries() -> dict:
    return {
        "op1_linededup": linededup.op1_linededup,
        "op2_html": html.op2_html,
        "op3_embeddings": embeddings.op3_embeddings,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality": quality.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_simhash": simhash.op7_simhash,
        "op8_langid": langid.op8_langid,
        "op9_packing": packing.op9_packing,
        "op10_sharding": sharding.op10_sharding,
        "op11_alignment": alignment.op11_alignment,
        "op12_substrings": substrings.op12_substrings,
        "op13_prefixtrie": prefixtrie.op13_prefixtrie,
    }


def oracle_sql() -> dict:
    return {
        "op4_mixing": mixing.ORACLE,
        "op5_quality": quality.ORACLE,
        "op13_prefixtrie": prefixtrie.ORACLE,
    }
