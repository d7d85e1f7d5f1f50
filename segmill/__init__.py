"""segmill: a Spark-native customer analytics and corpus engine."""
