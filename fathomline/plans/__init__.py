"""The dataflows: extraction, survey strata, lengths, model, limits, catch tables, reports."""
