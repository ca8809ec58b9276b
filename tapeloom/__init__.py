"""Spark-native market-microstructure panels: bars, as-of joins, rolling features, labels and scores."""
