"""Table-to-table operators; see the modules of this package."""
