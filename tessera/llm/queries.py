"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, classifier, language, minhash, mixing, quality_rules, records, vectors, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_language": language.op2_language,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_records": records.op4_token_records,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat": chat.op6_chat,
    "op7_bpe": bpe.op7_bpe,
    "op8_warc": warc.op8_warc,
    "op9_classifier": classifier.op9_classifier,
    "op10_vectors": vectors.op10_vectors,
}

ORACLE_SQL = {
    "op1_minhash": minhash.SQL,
    "op3_mixing": mixing.SQL,
    "op6_chat": chat.SQL,
    "op8_warc": warc.SQL,
    "op10_vectors": vectors.SQL,
}
