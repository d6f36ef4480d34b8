"""Every query of the engine and its SQL counterpart, by name."""

from __future__ import annotations

from corpusloom.plans import assembly, balance, builds, caches, cards, corpus, entries, evals, files, incremental, layouts, probes, replies, runs, sampling, settings, writing

QUERIES = {**corpus.QUERIES, **sampling.QUERIES, **evals.QUERIES, **incremental.QUERIES, **cards.QUERIES, **assembly.QUERIES, **layouts.QUERIES, **probes.QUERIES, **builds.QUERIES, **caches.QUERIES, **files.QUERIES, **replies.QUERIES, **runs.QUERIES, **balance.QUERIES, **writing.QUERIES, **entries.QUERIES, **settings.QUERIES}
SQL = {**corpus.SQL, **sampling.SQL, **evals.SQL, **incremental.SQL, **cards.SQL, **assembly.SQL, **layouts.SQL, **probes.SQL, **builds.SQL, **caches.SQL, **files.SQL, **replies.SQL, **runs.SQL, **balance.SQL, **writing.SQL, **entries.SQL, **settings.SQL}


def flagship(spark, sf_dir):
    """Keyword scan, hash-chosen template and spans over documents."""
    return corpus.reflection_spans(spark, sf_dir)
