"""Spark-native analytics for damage-aware genome binning: tables in, DataFrame programs, tables out."""
