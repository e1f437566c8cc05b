"""Operators on candidates, events and analyses."""
