"""Reusable plan fragments: blocked scans, materialised tables, derived panels."""
