"""One query per operator over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers

from echoloom.llm import (
    byte_bpe, classifier, conversation_repair, decontaminate, hilbert, language, quality_rules, secret_scan, simhash,
    sketches, suffix_dedup, token_files, tokenizer_alignment,
)
from echoloom.llm.batches import table


def op1_quality_rules(spark, sf):
    return quality_rules.score_quality(table(spark, sf, "documents"))


def op2_byte_bpe(spark, sf):
    return byte_bpe.encode_corpus(table(spark, sf, "documents"),
                                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_hilbert_shards(spark, sf):
    return hilbert.shard(table(spark, sf, "documents"))


def op4_quality_classifier(spark, sf):
    return classifier.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_simhash(spark, sf):
    return simhash.near_copies(table(spark, sf, "documents"))


def op6_secret_scan(spark, sf):
    return secret_scan.scan(table(spark, sf, "documents"))


def op7_language_id(spark, sf):
    return language.identify(table(spark, sf, "pages"), table(spark, sf, "documents"))


def op8_decontaminate(spark, sf):
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_token_files(spark, sf):
    return token_files.token_index(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


def op11_tokenizer_alignment(spark, sf):
    return tokenizer_alignment.align_corpus(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                            public_tokenizers.path("piece_bpe_32k.model"))


def op12_fingerprints(spark, sf):
    return sketches.fingerprint_edits(table(spark, sf, "documents"))


def op13_conversation_repair(spark, sf):
    conversations = table(spark, sf, "conversations")
    return conversation_repair.repair_conversations(conversation_repair.damage(conversations), conversations)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_byte_bpe, op3_hilbert_shards, op4_quality_classifier, op5_simhash, op6_secret_scan,
    op7_language_id, op8_decontaminate, op9_token_files, op10_suffix_dedup, op11_tokenizer_alignment,
    op12_fingerprints, op13_conversation_repair)}
# Their methods (expectation-maximisation, merges, links, suffix order, CRC) have no SQL form; tests/llm holds each
# against brute force.
ORACLE: dict[str, str] = {}
