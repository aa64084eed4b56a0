"""Readers: landing payloads to canonical rows."""
