"""Operators on molecules, pairs of them, and networks over pair graphs."""

from . import adjacency, assembly, canonical, graphconv, metrics, molecules, network, pairs, patterns, perception, ranges, scoring, stereo, training

__all__ = ["adjacency", "assembly", "canonical", "graphconv", "metrics", "molecules", "network", "pairs", "patterns", "perception", "ranges", "scoring", "stereo", "training"]
