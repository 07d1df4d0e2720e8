"""Readers and writers: pair tables, molecule blocks, lookups, datasets."""

from . import datasets, lookups, molblocks, npz, pairs, rows, smiles

__all__ = ["datasets", "lookups", "molblocks", "npz", "pairs", "rows", "smiles"]
