"""Registered queries by area, with their SQL."""

from textloom.plans import base, corpus, evaluation, feedback, maps, mining, retrieval, strings, texts, vectors  # noqa: F401

QUERIES, ORACLE_SQL = base.QUERIES, base.ORACLE_SQL
