"""Per-language scanners that cut source text into functions."""
