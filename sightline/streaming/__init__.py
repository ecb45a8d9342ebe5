"""Streaming versions of the scan, the tracker, the frame sampler and the provenance log."""
