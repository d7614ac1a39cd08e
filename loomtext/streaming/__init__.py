"""Incremental runs: resuming, bounded histories and running scores."""
