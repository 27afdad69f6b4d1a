"""Bounded sources and sinks: sheet exports in, indexed CSV out."""
