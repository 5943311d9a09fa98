"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from lexweave.llm import bpe, decontaminate, embeddings, html, language, licenses, lm, pii, simhash, spelling, substring, urls, whitening

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_language": language.op2_language,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_urls": urls.op5_urls,
    "op6_substring": substring.op6_substring,
    "op7_lm": lm.op7_lm,
    "op8_html": html.op8_html,
    "op9_licenses": licenses.op9_licenses,
    "op10_bpe": bpe.op10_bpe,
    "op11_pii": pii.op11_pii,
    "op12_whitening": whitening.op12_whitening,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_embeddings": embeddings.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_substring": substring.OP6_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
