"""Composite jobs: reports, digests, health, and the registered queries."""
