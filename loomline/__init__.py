"""loomline: Spark-native analytics over append-only conversation transcripts."""
