"""Queries of this subpackage, by the name under which they are registered, and their DuckDB SQL."""

from . import chat, columns, language_model, mixing, neighbours, packing, quality, simhash, substring, suffixes, urls

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_chat": chat.op2_chat,
    "op3_suffix_array": suffixes.op3_suffix_array,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_model": language_model.op5_language_model,
    "op6_packing": packing.op6_packing,
    "op7_url_filter": urls.op7_url_filter,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_neighbours": neighbours.op10_neighbours,
} | columns.QUERIES
ORACLE_SQL = {"op1_substring": substring.OP1_SQL, "op3_suffix_array": suffixes.OP3_SQL, "op8_mixing": mixing.OP8_SQL} | columns.ORACLE_SQL
