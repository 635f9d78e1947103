"""Composite operators (2K): backend dispatch, batch RAG, ingest, ground-truth build."""
