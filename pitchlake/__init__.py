"""Talent analytics at national scale as Spark jobs."""
