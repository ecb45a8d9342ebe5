"""Spark-native analytics over media evidence: identities, provenance, marks, videos, verdicts."""
