"""Cohort analytics on Spark: build, audit, partition and evaluate research cohorts with DataFrame functions."""
