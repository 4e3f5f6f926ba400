"""Whole jobs: compare images, extract layout, optimize regions."""
