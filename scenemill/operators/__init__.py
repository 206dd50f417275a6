"""Relational operators: selection, ordering, aggregates, timelines, segmentation, scripts, catalogues."""
