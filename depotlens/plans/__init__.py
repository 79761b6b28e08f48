"""Plans: the registered queries, the nightly run and its sinks."""
