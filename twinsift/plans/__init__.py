"""Registered queries: each pairs a Spark plan with the SQL that states the same result."""

from twinsift.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
