"""DataFrame-to-DataFrame operators; every table in and out is long."""
