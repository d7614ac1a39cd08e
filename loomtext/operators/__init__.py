"""Operators over records: reshaping, segmenting, spans, selection, diversity, statistics."""
