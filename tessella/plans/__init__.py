"""Registered queries: every operator applied to the tables at hand, with its SQL."""
