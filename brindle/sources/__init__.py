"""Readers and sinks: typed documents in, records and leads out."""
