"""foliant: retrieval-corpus jobs as DataFrame-to-DataFrame functions on Spark."""
