"""A small SQL front end: what it does not support it refuses with a typed error."""
