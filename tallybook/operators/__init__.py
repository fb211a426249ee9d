"""Sketches as aggregations over a long-form register table ``(keys..., i, r)``."""
