"""lantern: a Spark-first document search, scoring and corpus engine."""
