"""Queries of the text operators, by name."""

from __future__ import annotations

from emberlog.llm import common as C
from emberlog.llm import chat, decontaminate, html_extract, language_id, minhash_dedup, oracle, quality_rules, sentencepiece_lattice, token_counts, token_files, toxicity


def op1_toxicity(spark, sf_dir):
    return toxicity.scored(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")))


def op3_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return sentencepiece_lattice.round_trip(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(C.table(spark, sf_dir, "pages"), C.table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.digest(quality_rules.judged(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")))


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    folder = C.new_folder(spark, "tokens")
    shards = C.cut(token_files.write_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder), "shards")
    return token_files.digest(token_files.read_tokens(shards))


def op8_chat(spark, sf_dir):
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(turns.unionByName(own)))


def op9_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(C.table(spark, sf_dir, "documents"))


def op10_html_extract(spark, sf_dir):
    return html_extract.extract(C.table(spark, sf_dir, "pages"))


def queries():
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontaminate": op2_decontaminate,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_language_id": op4_language_id,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_counts": op6_token_counts,
        "op7_token_files": op7_token_files,
        "op8_chat": op8_chat,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql():
    return dict(oracle.SQL)
