"""Streams: files that keep coming in, history that is kept, and replies of which only the latest counts."""
