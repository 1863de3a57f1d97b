"""DataFrame operators: ledger, quality, inventory, history, records, catalogue, alerts."""
