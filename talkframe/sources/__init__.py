"""Readers and writers: episode JSON, RSS feeds, catalogue JSON, ground-truth CSV, transcript
JSON, and the on-disk index layout."""
