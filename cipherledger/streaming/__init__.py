"""streaming of the cryptographic inventory."""
