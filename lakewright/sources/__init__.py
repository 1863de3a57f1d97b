"""Where data comes from: landing folders, listings, nested documents, external systems."""
