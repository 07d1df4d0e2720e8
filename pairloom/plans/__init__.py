"""The operators over relational tables: an order is a molecule, its parts are the atoms, and two orders make a pair."""
