"""Column classification, small-table helpers and reusable column expressions."""
