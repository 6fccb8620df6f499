"""Scoring of answers and tool use against ground truth."""
