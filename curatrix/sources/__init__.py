"""Readers, writers and explicit schemas."""
