"""Session, shared storage, provenance and checks."""
