"""korpusverk: paired-corpus text analytics as lazy Spark DataFrame pipelines."""
