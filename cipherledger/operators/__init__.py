"""operators of the cryptographic inventory."""
