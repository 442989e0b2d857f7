"""The stateless row transforms on file streams."""
