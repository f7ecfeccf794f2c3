"""The analytical operators. Import from the modules."""
