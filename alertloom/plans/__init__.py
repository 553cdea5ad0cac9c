"""Queries over the driver's tables (``catalog``) and lineage cuts (``stage``)."""
