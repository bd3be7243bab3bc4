"""Operators: functions from DataFrames to DataFrames.

Data are long and sparse: features(sample_id, feature_id, value) without zeros, and
samples(sample_id, label, ...) with every sample, so that one without features still counts.
"""
