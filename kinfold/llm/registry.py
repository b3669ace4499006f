"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers

from kinfold.llm import bitplanes, chunkreuse, decisionlist, gam, interleave, ngramjoin, posindex, skipchain, suffixes, toxicity
from kinfold.llm.common import table


def op1_bit_planes(spark, sf_dir):
    return bitplanes.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_stratified_interleave(spark, sf_dir):
    return interleave.stratified_interleave(table(spark, sf_dir, "documents"))


def op3_chunk_reuse(spark, sf_dir):
    return chunkreuse.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_skip_chain(spark, sf_dir):
    return skipchain.personal_data(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_prefix_tree_join(spark, sf_dir):
    return ngramjoin.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_lexicon_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_additive_quality(spark, sf_dir):
    return gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_positional_index(spark, sf_dir):
    return posindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_decision_list(spark, sf_dir):
    return decisionlist.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    found = (
        op1_bit_planes,
        op2_stratified_interleave,
        op3_chunk_reuse,
        op4_skip_chain,
        op5_suffix_dedup,
        op6_prefix_tree_join,
        op7_lexicon_toxicity,
        op8_additive_quality,
        op9_positional_index,
        op10_decision_list,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_stratified_interleave": interleave.SQL,
        "op6_prefix_tree_join": ngramjoin.SQL,
        "op9_positional_index": posindex.SQL,
    }
