"""Queries over the driver's tables: importing the package registers all of them."""

from brindle.plans import coverage, suites

__all__ = ["coverage", "suites"]
