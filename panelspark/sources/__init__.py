"""Readers, bar builders, dimension tables and writers."""
