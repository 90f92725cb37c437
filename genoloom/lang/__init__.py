"""The query language: text to syntax tree, and the checks made before planning."""
