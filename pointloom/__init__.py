"""pointloom: a Spark-native engine for multidimensional point data."""
