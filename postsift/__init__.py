"""Listing analytics on Spark: extract, match, dedup, track, alert and report."""
