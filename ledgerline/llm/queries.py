"""The queries of this subpackage. None of their results can be had from portable SQL: they
rest on models trained here, hashes that SQL engines do not share, or walks over texts; the
tests hold them against brute force, round trips and held-out labels instead."""

from __future__ import annotations

from . import op1_html, op2_toxicity, op3_mixing, op4_langid, op5_simhash, op6_quality, op7_pii, op8_fingerprints, op9_chat, op10_decontamination, op11_centroids, op12_repair, op13_lmscore


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_html_extraction": op1_html.query,
    "op2_toxicity": op2_toxicity.query,
    "op3_mixing": op3_mixing.query,
    "op4_language_id": op4_langid.query,
    "op5_simhash": op5_simhash.query,
    "op6_quality": op6_quality.query,
    "op7_pii": op7_pii.query,
    "op8_fingerprints": op8_fingerprints.query,
    "op9_chat_formatting": op9_chat.query,
    "op10_decontamination": op10_decontamination.query,
    "op11_centroid_clustering": op11_centroids.query,
    "op12_conversation_repair": op12_repair.query,
    "op13_lm_scoring": op13_lmscore.query,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {}
