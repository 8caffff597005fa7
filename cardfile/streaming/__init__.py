"""Streaming of the contact-data library."""
