"""Outlines, pages, first-wins merges and cursors."""
