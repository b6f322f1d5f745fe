"""Plan building blocks: written tables, hash-order cut-offs, running sums, lookups."""
