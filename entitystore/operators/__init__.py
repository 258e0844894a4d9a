"""Statistics, maintenance and differences as DataFrame operators."""
