"""Queries over the given tables, each with its SQL counterpart."""

from . import depth, fuse, graphs, grids, guided, reprojection, stats, textures, views
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "depth", "fuse", "graphs", "grids", "guided", "reprojection", "stats", "textures", "views"]
