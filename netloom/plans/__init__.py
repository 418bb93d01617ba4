"""End-to-end jobs composed of the operators, and the registered queries."""
