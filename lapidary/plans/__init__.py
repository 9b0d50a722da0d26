"""Queries of the placement engine: name -> (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

from lapidary.plans import beads, checks, colors, designs, distances, fills, geometry, imports, matches, pictures, records, repairs

_MODULES = [distances, colors, records, beads, matches, geometry, imports, checks, repairs, pictures, fills]
QUERIES = designs.QUERIES | {name: f for m in _MODULES for name, f in m.query.queries.items()}
# rows in a fixed order, so that a reader of the first rows gets the same ones
ORACLES = {name: f"{sql}\nORDER BY ALL" for name, sql in (designs.ORACLES | {name: q for m in _MODULES for name, q in m.query.oracles.items()}).items()}
