"""Composite plans: sample, features, model, outliers, dashboard, retrieval."""
