"""Whole plans: scoring one or many dependencies, experiments, the runner."""
