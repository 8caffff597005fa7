"""Sources of the contact-data library."""
