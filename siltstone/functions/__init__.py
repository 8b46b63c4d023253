"""Part of the siltstone library."""
