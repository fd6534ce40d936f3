"""Column functions: identity keys, field readers, scoring."""
