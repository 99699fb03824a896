"""Schemas of the engine's tables, as DDL."""

CLONOTYPES = "dataset string, sample string, row_id long, cdr3 string, v string, j string, freq double, full_seq string"
CENTROIDS = "cluster int, vec array<double>"
MAPPING = "primary int, func int"
ENCODED = "dataset string, sample string, label int, cluster int, diversity long, abundance double"
FEATURES = "dataset string, sample string, vec array<double>"
SEGMENTS = "kind string, ord long, id string, gene string, seq string"
