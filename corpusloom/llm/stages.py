"""Durable stage tables, as the rest of the library has them."""

from corpusloom.plans.stages import Stages, shared_dir

__all__ = ["Stages", "shared_dir"]
