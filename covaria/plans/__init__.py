"""Whole jobs, and the catalogue of registered queries."""
