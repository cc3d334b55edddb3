"""Whole workflows composed of operators, and the fixtures they run on."""
