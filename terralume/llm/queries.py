"""Queries of this subpackage, and their SQL where SQL can express them."""

from . import jaccard, mixing, packing, periodic, pii, pitman_yor, progressive_jpeg, quality, spelling, token_counts, topk, toxicity, url_rules

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_quality_bradley_terry": quality.op3_quality_bradley_terry,
    "op4_poisson_mixing": mixing.op4_poisson_mixing,
    "op5_progressive_jpeg": progressive_jpeg.op5_progressive_jpeg,
    "op6_toxicity_crf": toxicity.op6_toxicity_crf,
    "op7_url_association_rules": url_rules.op7_url_association_rules,
    "op8_pii_crf": pii.op8_pii_crf,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_token_resync": token_counts.op11_token_resync,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLE = {"op1_exact_topk": topk.OP1_SQL, "op4_poisson_mixing": mixing.OP4_SQL, "op7_url_association_rules": url_rules.OP7_SQL, "op9_ngram_jaccard_join": jaccard.OP9_SQL}
