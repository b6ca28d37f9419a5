"""Plans of factloom: the queries of the core and their SQL."""

from factloom.plans import evidence, facts, networks, quantities, resolution, texts  # noqa: F401
from factloom.plans.registry import ORACLE, QUERIES  # noqa: F401
