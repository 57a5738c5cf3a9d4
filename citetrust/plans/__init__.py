"""Whole jobs: artifacts in, artifacts out."""
