"""Graph analytics on Spark: tables, nested records and building models to triples and back."""
