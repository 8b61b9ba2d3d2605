"""Cleaning, signals, windows, features, fusion, decoding, metrics, selection and learning."""
