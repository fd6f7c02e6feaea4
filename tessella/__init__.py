"""A Spark-native engine for systematic-strategy research over long-format panel data."""
