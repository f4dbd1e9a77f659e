"""Registered queries: operators applied to the domain views, each with its SQL."""
