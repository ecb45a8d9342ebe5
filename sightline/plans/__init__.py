"""Composed plans: verdicts, evidence records, scans, videos."""
