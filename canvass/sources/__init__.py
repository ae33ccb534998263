"""Readers, writers and the revisioned dataset store."""
