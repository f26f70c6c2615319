"""Work that goes on in the background."""
