"""labflow: laboratory reports to typed, audited tables, on Spark."""
