"""Queries of the training-data operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from . import ann, byte_bpe, chat, ctw, decontaminate, fim, licenses, minhash, pii, quality, resample, token_file, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_chat": chat.op2_chat,
    "op3_licenses": licenses.op3_licenses,
    "op4_warc": warc.op4_warc,
    "op5_token_file": token_file.op5_token_file,
    "op6_ann": ann.op6_ann,
    "op7_ctw": ctw.op7_ctw,
    "op8_minhash": minhash.op8_minhash,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_fim": fim.op11_fim,
    "op12_pii": pii.op12_pii,
    "op13_resample": resample.op13_resample,
}

ORACLES: dict[str, str] = {
    "op2_chat": chat.ORACLE_OP2,
    "op3_licenses": licenses.ORACLE_OP3,
    "op4_warc": warc.ORACLE_OP4,
    "op11_fim": fim.ORACLE_OP11,
}
