"""Plans: the original pipeline's entry points composed from operators (curation, preparation,
evaluation, scoring, training) and the registry of named queries."""
