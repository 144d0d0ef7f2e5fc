"""Training-data pipeline operators: one module per operator, plus their registered queries."""
