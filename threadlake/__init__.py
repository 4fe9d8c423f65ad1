"""Session search, note search and corpus preparation as Spark plans."""
