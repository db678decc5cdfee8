"""Schemas of input and output files."""

from __future__ import annotations

# Column names and their order in the files.
NODELIST = (
    "node_id INT, type STRING, year INT, alpha DOUBLE, pa_weight DOUBLE, fit_weight DOUBLE, num_authors_weight DOUBLE, "
    "author_reputation_weight DOUBLE, fit_lag_duration INT, fit_peak_value INT, fit_peak_duration INT, in_degree INT, out_degree INT, "
    "assigned_out_degree INT, planted_nodes_line_number INT, generator_node_string STRING, sampled_neighborhood_size INT, "
    "fully_random_citations INT, author_id INT, num_authors INT, initial_author_reputation INT, final_author_reputation INT, cartel_id INT, cluster_id INT"
)
PLANTED = {
    "year": "INT", "pa_weight": "DOUBLE", "fit_weight": "DOUBLE", "num_authors_weight": "DOUBLE", "author_reputation_weight": "DOUBLE",
    "alpha": "DOUBLE", "out_degree": "INT", "fit_lag_duration": "INT", "fit_peak_value": "INT", "fit_peak_duration": "INT",
    "num_authors": "INT", "author_id": "INT",
}
CLONAL = {
    "num_authors": "INT", "out_degree": "INT", "fit_lag_duration": "INT", "fit_peak_value": "INT", "fit_peak_duration": "INT",
    "pa_weight": "DOUBLE", "fit_weight": "DOUBLE", "num_authors_weight": "DOUBLE", "author_reputation_weight": "DOUBLE", "alpha": "DOUBLE",
}
NODE_COLUMNS = [c.split()[0] for c in NODELIST.split(", ")]
