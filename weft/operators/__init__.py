"""Sinks of rule results."""
