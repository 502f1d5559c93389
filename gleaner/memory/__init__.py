"""Named recordsets that carry lineage from one analysis stage to the next."""
