"""Building blocks shared by the operators: chunked windows, runs, ranks, sessions."""
