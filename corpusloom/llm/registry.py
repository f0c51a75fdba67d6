"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat_format, exact_dedup, fingerprints, jaccard_join, language_id, license_scan, line_dedup, mixing, packing, toxicity

_MODULES = (language_id, chat_format, exact_dedup, packing, mixing, fingerprints, license_scan, line_dedup, jaccard_join, toxicity)


def queries() -> dict:
    """Each module's function op<N>_<name>."""
    return {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.ORACLE_SQL, "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op9_jaccard_join": jaccard_join.ORACLE_SQL}
