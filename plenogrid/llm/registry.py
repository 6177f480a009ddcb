"""The queries of the corpus operators."""

from __future__ import annotations

from . import ann, bpe, licences, mixture, neardup, phrases, quality, repeats, secrets, spelling, tokenfile, vectordup, webtext

QUERIES = {
    "op1_collision_counting_ann": ann.query,
    "op2_html_crf": webtext.query,
    "op3_mix_sources": mixture.query,
    "op4_suffix_array_dedup": repeats.query,
    "op5_minhash_odd_sketches": neardup.query,
    "op6_bpe_pair_index": bpe.query,
    "op7_token_bit_planes": tokenfile.query,
    "op8_licence_scan": licences.query,
    "op9_quality_nbsvm": quality.query,
    "op10_rotated_code_neardup": vectordup.query,
    "op11_trigram_secrets": secrets.query,
    "op12_variable_gram_variants": spelling.query,
    "op13_phrase_tries": phrases.query,
}
ORACLES = {
    "op3_mix_sources": mixture.ORACLE,
    "op8_licence_scan": licences.ORACLE,
    "op11_trigram_secrets": secrets.ORACLE,
    "op13_phrase_tries": phrases.ORACLE,
}
