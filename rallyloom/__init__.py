"""Rallyloom: trajectories, match statistics and data curation on PySpark."""
