"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from plyframe.llm import chat, decontaminate, editprints, extract, importance, langid, linededup, mixing, negatives, pii, simhash, vectors, warc

QUERIES = {
    "op7_embedding_dedup": vectors.op7_embedding_dedup,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op8_extract": extract.op8_extract,
    "op10_pii": pii.op10_pii,
    "op3_language_id": langid.op3_language_id,
    "op2_warc": warc.op2_warc,
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op4_simhash": simhash.op4_simhash,
    "op5_chat_format": chat.op5_chat_format,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_edit_fingerprint": editprints.op12_edit_fingerprint,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op7_embedding_dedup": vectors.OP7_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op2_warc": warc.OP2_SQL,
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_importance": importance.OP13_SQL,
}
