"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from anchorline.llm import ann, brown_lm, chat_format, mixing, ngram_join, prefix_trie, quality_classifier, quality_rules, sentencepiece_codec, sharding, token_alignment, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_warc": warc.op6_warc,
    "op7_brown_lm": brown_lm.op7_brown_lm,
    "op8_sharding": sharding.op8_sharding,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ann": ann.op10_ann,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_chat_format": chat_format.op13_chat_format,
}

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op4_ngram_join": ngram_join.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_chat_format": chat_format.ORACLE_SQL,
}
