"""Readers and writers of image layouts, metadata logs and benchmark output."""
