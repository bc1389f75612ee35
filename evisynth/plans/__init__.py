"""Registered queries, by subject."""

from . import corpus, evidence, records, runs, screening, statistics

REGISTRIES = [screening.R, statistics.R, corpus.R, evidence.R, records.R, runs.R]
