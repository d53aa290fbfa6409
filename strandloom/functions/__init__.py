"""Subpackage of strandloom."""
