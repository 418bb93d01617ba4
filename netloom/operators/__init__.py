"""DataFrame transforms: filters, profiles, marginals, divergences, series and windows."""
