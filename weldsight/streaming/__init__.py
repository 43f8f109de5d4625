"""Keyed state for online scoring, and sinks."""
