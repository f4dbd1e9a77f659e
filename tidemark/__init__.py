"""Point-in-time analytics on Spark: bitemporal reads, cross-sections, scoring, publication and audits as DataFrame functions."""
