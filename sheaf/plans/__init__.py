"""Extraction specs and the planner that infers and compiles them."""
