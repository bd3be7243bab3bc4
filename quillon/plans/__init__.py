"""Loops of Spark jobs: fitting, regularisation paths, ensembles, cross-validation."""
