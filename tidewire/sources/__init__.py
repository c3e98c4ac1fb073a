"""Readers that turn captured feeds, pages and dumps into article rows."""
