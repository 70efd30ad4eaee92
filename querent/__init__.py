"""querent: document question-answering robustness analytics expressed in Spark."""
