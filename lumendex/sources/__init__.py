"""The versioned document store."""
