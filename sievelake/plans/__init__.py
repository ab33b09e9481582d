"""The catalogue of queries with their SQL oracles, and the fixture views both run on."""
