"""The queries of this subpackage, with their SQL where SQL can express them."""

from tracewell.llm import chat, decontaminate, fingerprints, line_templates, mixing, near_dups, periodic, phrases, pseudonyms, quality, secret_scan, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_minhash_near_dedup": near_dups.op2_minhash_near_dedup,
    "op3_pseudonyms": pseudonyms.op3_pseudonyms,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_line_templates": line_templates.op5_line_templates,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_collocations": phrases.op12_collocations,
    "op13_warc": warc.op13_warc,
}

ORACLE = {
    "op2_minhash_near_dedup": near_dups.OP2_SQL,
    "op5_line_templates": line_templates.OP5_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_warc": warc.OP13_SQL,
}
