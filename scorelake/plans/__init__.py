"""Whole flows composed of operators: scoring, re-judging, comparison."""
