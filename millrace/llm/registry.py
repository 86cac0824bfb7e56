"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import fingerprint, jaccard, katz, media, neighbours, packing, phrases, quality, resampling, secrets, sentence, suffix, toxicity

QUERIES = {
    "op1_suffix": suffix.op1_suffix,
    "op2_secrets": secrets.op2_secrets,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": sentence.op4_sentencepiece,
    "op5_katz": katz.op5_katz,
    "op6_media": media.op6_media,
    "op7_quality": quality.op7_quality,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_packing": packing.op10_packing,
    "op11_phrases": phrases.op11_phrases,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL: dict[str, str] = {"op9_jaccard": jaccard.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op12_neighbours": neighbours.ORACLE_SQL, "op13_resampling": resampling.ORACLE_SQL}
