"""The four batch stages: ingest, features, propensity, and the report export."""
