"""Queries that apply the operators to the given tables, with their SQL."""

from siltstone.plans import corpus, findings, gates, names, packs, readers, reviews, scans, singles, storage, structure, surface

MODULES = (corpus, findings, gates, names, packs, readers, reviews, scans, singles, storage, structure, surface)
