"""Extension: the stateless stages over a drop directory."""
