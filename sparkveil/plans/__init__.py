"""Plan helpers that several operators share: shared-folder tables and graph components."""
