"""Inclusion-based points-to analysis as Spark relational dataflow."""
