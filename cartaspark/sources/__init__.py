"""Readers and writers of bounds, lists, images and tile stores."""
