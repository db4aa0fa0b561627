"""Verbs that split, fit, answer and measure."""
