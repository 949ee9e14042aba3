"""Spark-native analytics for catalogs of software records and the discussions around them."""
