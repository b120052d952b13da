"""A Spark-first engine for collecting, organising and querying news-style documents."""
