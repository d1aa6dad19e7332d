"""Settings of one covariate job."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

# Names of the settings in a job file, and the output key layouts.
JOB_FILE_NAMES = {
    "task": "TASK",
    "span_start": "SPAN_START",
    "span_end": "SPAN_END",
    "top_ngrams": "NGRAMS_TO_EXTRACT",
    "all_ngrams": "NGRAMS_EXTRACT_ALL",
    "preprocessor": "PREPROCESSOR",
    "algorithm": "ALGORITHM",
    "embeddings": "EMBEDDINGS",
    "iterations": "ITERATIONS",
    "passes": "PASSES",
    "topic_counts": "K_TOPICS_LIST",
    "output_elements": "OUTPUT_ELEMENTS",
}
OUTPUT_ELEMENTS = (
    "empi",
    "empi_expdate",
    "empi_expdate_notedate",
    "empi_expdate_notetype",
    "empi_expdate_notedate_notetype",
    "empi_expdate_notedate_diff_notetype",
    "comb_empi_expdate_notedate_diff_notetype",
)


@dataclass(frozen=True)
class JobConfig:
    """Window, vocabulary and topic settings with the usual values."""

    task: str = "cohort"
    span_start: int = 0
    span_end: int = 365
    top_ngrams: int = 20_000
    all_ngrams: bool = False
    preprocessor: str = "nltk"
    algorithm: tuple[str, ...] = ("ngram", "embedding", "topic_model")
    embeddings: tuple[str, ...] = ()
    iterations: int = 50
    passes: int = 10
    topic_counts: tuple[int, ...] = (5, 6)
    keep_terms: int = 100_000
    output_elements: str = "empi_expdate_notedate_diff_notetype"

    @classmethod
    def from_json(cls, text: str) -> JobConfig:
        """Read a job file; its values are strings or lists of strings."""
        given = json.loads(text)
        values = {}
        for field in fields(cls):
            raw = given.get(JOB_FILE_NAMES.get(field.name))
            if raw is None:
                continue
            kind = type(getattr(cls, field.name))
            if kind is bool:
                values[field.name] = str(raw).lower() == "true"
            elif kind is tuple:
                items = raw.split() if isinstance(raw, str) else list(raw)
                values[field.name] = tuple(
                    int(i) if field.name == "topic_counts" else i for i in items
                )
            else:
                values[field.name] = kind(raw)
        return cls(**values)

    def key_layout(self) -> str:
        """The output layout; an unknown name means the full note-level one."""
        known = self.output_elements in OUTPUT_ELEMENTS
        return self.output_elements if known else OUTPUT_ELEMENTS[5]
