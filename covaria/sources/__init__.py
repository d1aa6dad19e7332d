"""Readers, writers and the views that derive inputs from the shared test tables."""
