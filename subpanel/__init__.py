"""Subscriber-panel analytics on Spark: monthly extracts to offers, risk, profiles and serving views."""
