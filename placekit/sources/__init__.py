"""Readers and writers: raw geodata in, published tables and files out."""
