"""Structured Streaming: files imported as they arrive, late observations recalculated."""
