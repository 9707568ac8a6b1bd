"""Boolean query parsing and the catalogue of registered queries."""
