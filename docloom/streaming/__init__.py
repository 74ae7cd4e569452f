"""Structured Streaming: resumable incremental work and windows over events."""
