"""Empty: no query of this engine is over a stream; a snapshot is replaced as a whole (quarry.sources.catalog)."""
