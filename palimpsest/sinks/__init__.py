"""Writers: text, LaTeX, PDF and JSON."""
