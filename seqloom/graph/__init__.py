"""Traversals of graphs and algorithms composed of them.

A graph is a DataFrame of directed edges (edge_id, src, dst, ...) in rows of src, and a DataFrame of
vertices (id, ...).
"""
