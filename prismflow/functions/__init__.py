"""Part of prismflow."""
