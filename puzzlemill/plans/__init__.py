"""Stage graphs, artifact lineage and the registered queries."""
