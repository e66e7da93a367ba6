"""Predicates of rules as Spark columns."""
