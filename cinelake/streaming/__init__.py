"""Streaming: sessions of hits as they arrive, and maintenance driven by micro-batches."""
