"""Corpora that keep arriving: counts kept in the state of a stream."""
