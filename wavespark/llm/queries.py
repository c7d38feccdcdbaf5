"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import canonical, exact, language, licenses, mixing, packing, repeats, simhash, tokens, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_repeats": repeats.op2_repeats,
        "op3_simhash": simhash.op3_simhash,
        "op4_packing": packing.op4_packing,
        "op9_token_output": tokens.op9_token_output,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_licenses": licenses.op6_licenses,
        "op7_language": language.op7_language,
        "op8_document_fingerprints": canonical.op8_document_fingerprints,
        "op10_exact_dedup": exact.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op10_exact_dedup": exact.SQL}
