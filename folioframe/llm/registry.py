"""The queries of this subpackage, and the SQL that must agree with them."""

from __future__ import annotations

from folioframe.llm import op3_warc
from folioframe.llm.op1_suffix_dedup import op1_suffix_dedup
from folioframe.llm.op2_quality_rules import op2_quality_rules
from folioframe.llm.op3_warc import op3_warc_index
from folioframe.llm.op4_fingerprints import op4_minhash_fingerprints
from folioframe.llm.op5_packing import op5_power_of_two_packing
from folioframe.llm.op6_bpe import op6_bpe_round_trip
from folioframe.llm.op7_quality_classifier import op7_quality_classifier
from folioframe.llm.op8_sharding import op8_label_propagation_shards
from folioframe.llm.op9_secrets import op9_secret_scan
from folioframe.llm.op10_simhash import op10_simhash

_QUERIES = (
    op1_suffix_dedup,
    op2_quality_rules,
    op3_warc_index,
    op4_minhash_fingerprints,
    op5_power_of_two_packing,
    op6_bpe_round_trip,
    op7_quality_classifier,
    op8_label_propagation_shards,
    op9_secret_scan,
    op10_simhash,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL lacks the hashes, automata, vocabularies and models of the others; tests hold those against brute force."""
    return {op3_warc_index.__name__: op3_warc.ORACLE_SQL}
