"""Covariates from clinical notes, term mentions, vectors and codes, as Spark jobs."""

from covaria.config import JobConfig

__all__ = ["JobConfig"]
