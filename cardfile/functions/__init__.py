"""Functions of the contact-data library."""
