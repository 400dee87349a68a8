"""The catalog of layers and relations, and the packager that plans and runs over it."""
