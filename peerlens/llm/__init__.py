"""Operators for preparing training text: extraction, cleaning, near duplicates, scoring, mixing and encoding."""
