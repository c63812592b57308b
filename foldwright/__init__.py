"""Spark-first analytics for honest model selection: folds, encodings, search spaces, selection, ledgers, blends."""
