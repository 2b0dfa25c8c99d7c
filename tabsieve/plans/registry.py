"""Registry of queries and their SQL oracles."""

from __future__ import annotations

from tabsieve.plans import queries_distance, queries_learning, queries_privacy, queries_relation, queries_table

MODULES = (queries_table, queries_privacy, queries_distance, queries_relation, queries_learning)


def flagship(spark, sf_dir):
    return queries_learning.refined(spark, sf_dir)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: s for m in MODULES for name, s in m.SQL.items()}
