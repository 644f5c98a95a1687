"""Larkspur: campaign analytics and record-level decisions as Spark DataFrame queries."""
