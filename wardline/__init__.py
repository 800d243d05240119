"""wardline: a Spark-first engine for age-aware ranking data and its evaluation."""
