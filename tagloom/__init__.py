"""Price-tag analytics on Spark: text parsing, track fusion, catalog matching, evaluation and job reporting."""
