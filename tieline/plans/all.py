"""Importing this module registers every query."""

from tieline.plans import catalog_queries, composite_queries, matching_queries, pixel_queries, recipe_queries, source_queries, tile_queries, tiepoint_queries  # noqa: F401
