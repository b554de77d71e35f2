"""Spark jobs for segmenting, clustering and scoring range-sensor point streams."""
