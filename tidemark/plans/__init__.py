"""Declarations, rules, walks and documents."""
