"""Readers and writers: images, tables, graphs, tracks, block matrices."""
