"""Operators over corpora and documents."""
