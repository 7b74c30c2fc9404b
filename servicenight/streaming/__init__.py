"""Incremental loading of exports."""
