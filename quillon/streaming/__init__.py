"""Structured Streaming over events: an extension, no counterpart of a reference operator."""
