"""Streams of slides and annotations.

Grids, filters by label, geometry and joins with a static table are row-local, so they apply to a stream as they are.
"""
