"""Incremental jobs: every run handles what arrived since the last one, then stops."""
