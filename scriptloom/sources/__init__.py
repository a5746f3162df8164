"""Reading staged scripts and keeping the registry and the completion ledger."""
