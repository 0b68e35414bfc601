from workers import rows_elsewhere


def test_queries_on_workers_without_the_repository(tmp_path):
    got = rows_elsewhere(tmp_path, ["cosine_topk", "gmm_confidence", "gmm_diag_fit", "embed_texts", "ivf_topk", "assign_new", "silhouette_estimated", "semantic_chunks", "answers_kept", "explained_components", "store_scan"])
    assert got["gmm_confidence"] == got["gmm_diag_fit"] == 500 and got["embed_texts"] == 200 and got["cosine_topk"] > 0
    assert got["ivf_topk"] == 25 and got["assign_new"] == 250 and got["silhouette_estimated"] == 1 and got["semantic_chunks"] > 200
