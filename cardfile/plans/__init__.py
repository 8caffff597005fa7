"""Plans of the contact-data library."""
