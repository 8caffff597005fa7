"""Operators of the contact-data library."""
