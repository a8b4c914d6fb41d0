"""Loads every module that registers queries."""

from folio.plans import classification, core, detect, embedding, graph, labels, passage, qualify, questions, regularity, reports, robust, runrate, signals, universe  # noqa: F401
