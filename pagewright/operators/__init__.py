"""DataFrame operators: order, assignment, matching, tables, validation, scores and comparisons."""
