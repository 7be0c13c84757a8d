"""chronofold: versioned record analytics on Spark (snapshots, change logs, folds)."""
