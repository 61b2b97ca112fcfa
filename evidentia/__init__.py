"""Evidence analytics over documents, series and events, written as Spark jobs."""
