"""sources of the cryptographic inventory."""
