"""bitlab: Spark-native analytics over very long symbol and bit sequences."""
