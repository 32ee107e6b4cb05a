"""Writing and maintaining relations."""
