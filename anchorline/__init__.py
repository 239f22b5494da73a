"""Spark-native projection of genomic points between species."""
