"""Part of the fathom package."""
