"""Readers: machine CSV files, preprocessed Parquet, requests as JSON, bundles, and the event table as a sensor stream."""
