"""plans of the cryptographic inventory."""
