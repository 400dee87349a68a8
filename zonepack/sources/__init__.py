"""Reading layers and writing packages."""
