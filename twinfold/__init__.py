"""Duplicate and near-duplicate detection over file and document collections, on Spark."""
