"""Registered queries of this subpackage with their SQL twins, where SQL can express one."""

from __future__ import annotations

from barlake.llm import decontaminate, html_hosts, language, licences, merkle, ordinal, packing, periods, phrases, pieces, sanitise, simhash, warc

QUERIES = {
    "op1_main_text": html_hosts.op1_main_text,
    "op2_ordinal_quality": ordinal.op2_ordinal_quality,
    "op3_phrase_fingerprints": phrases.op3_phrase_fingerprints,
    "op4_window_packing": packing.op4_window_packing,
    "op5_word_backoff_language": language.op5_word_backoff_language,
    "op6_latent_decontamination": decontaminate.op6_latent_decontamination,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_licence_paragraphs": licences.op8_licence_paragraphs,
    "op9_disclosure_spans": sanitise.op9_disclosure_spans,
    "op10_simhash": simhash.op10_simhash,
    "op11_interval_manifest": merkle.op11_interval_manifest,
    "op12_piece_digests": pieces.op12_piece_digests,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
SQL: dict[str, str] = {"op11_interval_manifest": merkle.OP11_SQL}
