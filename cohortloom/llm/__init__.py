"""Operators for preparing training text: scans, filters, near duplicates, scoring, mixing and packing."""
