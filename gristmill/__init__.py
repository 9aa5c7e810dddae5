"""gristmill: a Spark-first engine for inductive-rule datasets."""
