import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
from workers import rows_elsewhere


def test_llm_queries_on_workers_without_the_repository(tmp_path):
    whole = [f"op{n}" for n in ("1_line_dedup", "2_token_counts", "4_language_id", "5_quality_classifier", "6_mixing", "8_suffix_dedup", "9_quality_rules", "10_minhash", "13_importance_resampling")]
    got = rows_elsewhere(tmp_path, [*whole, "op3_url_filters", "op7_decontamination", "op11_source_divergence", "op12_best_fit_packing", "pipeline"])
    assert all(got[n] == 200 for n in whole) and got["op3_url_filters"] == 50
    assert all(got[n] > 0 for n in ("op7_decontamination", "op11_source_divergence", "pipeline")) and got["op12_best_fit_packing"] >= 200
