"""All queries of the library: importing a catalogue registers its queries."""

from __future__ import annotations

from terrane.plans import catalogue, catalogue_cells, catalogue_engine, catalogue_mechanisms, catalogue_shapes

CATALOGUES = (catalogue, catalogue_cells, catalogue_engine, catalogue_shapes, catalogue_mechanisms)
queries, oracle_sql = catalogue.queries, catalogue.oracle_sql
