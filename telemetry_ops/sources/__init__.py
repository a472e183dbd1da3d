"""Readers, writers and the adapter that rolls raw events up to telemetry."""
