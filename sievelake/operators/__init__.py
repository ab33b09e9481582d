"""DataFrame -> DataFrame operators: search, facets, ingest, profiles, lifecycle, probes, runs."""
