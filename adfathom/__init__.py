"""Campaign analytics on Spark: quality gate, rollups, scoring, back-test and budget advice."""
