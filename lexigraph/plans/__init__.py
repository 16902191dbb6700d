"""Whole jobs: the build, the server queries, the driver queries."""
