"""Detectors: one file's text or bytes to findings. Each is a plain function; ``run`` maps them over a DataFrame of files."""
