"""Readers of PDF and image bytes, and writers of changed ones."""
