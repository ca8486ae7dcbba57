"""Streams of files into an index."""

from seamline.streaming.ingest import follow_files, stream_terms

__all__ = ["follow_files", "stream_terms"]
