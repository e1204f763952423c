"""functions of the cryptographic inventory."""
