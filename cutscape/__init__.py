"""Edit-outcome analytics on Spark: profiles, comparisons, candidate edits, read mapping and prediction."""
