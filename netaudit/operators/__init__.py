"""DataFrame transformations: joins, aggregates, windows, field checks, spatial checks, bill of materials."""
