"""Composite plans: cleaning, features, tracking, narratives, alerts, views."""
