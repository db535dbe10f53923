"""Dataset contracts, publishing and gates."""
